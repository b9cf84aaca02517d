"""Native inspection: requests that refer to prefixes of earlier ones, and where contexts were compacted.

A request names a base, how many of the base's references it keeps, and a tail of its own.  A log can
hold hundreds of thousands of them, each on top of the one before, so neither is a file
folded in one task nor are references copied from request to request.  They form a forest, and
what a request needs to know of its prefix is found by pointer jumping, where the number of joins
is the logarithm of the depth:

- whether a base is long enough, where that depends on the base's own base;
- the owner of a prefix's last reference: the nearest ancestor that keeps less than the
  request does.  From owner to owner a request's references are cut out of their tails;
- along owners, the latest line of a referenced blob, the earliest conflict and a digest of the sequence;
- along bases, whether the sequence is complete.

References are resolved among the records before the request in its file; nothing is filled in from
later records or other files.  Compaction coordinates are places in the source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.pointers import climb
from loomspark.sources.cache import stored

# Kinds of records, and codes of diagnostics.
BLOB, SHAPE, REQUEST = "api-request-blob", "api-request-shape", "api-request"
INCOMPLETE = ("missing_base", "unsupported")
_NEVER = (1 << 62) - 1
#: Lines that are looked through in one sort.
BLOCK = 1 << 16
COORDINATES = ("line_no", "byte_offset", "raw_bytes")
_DIAGNOSTICS = "array<struct<code:string,message:string,reference:string>>"


@dataclass
class Inspection:
    """Tables of an inspection, all by path.

    requests: line_no, byte_offset, raw_bytes, id, query_source, shape_hash, base_line, keep, n_refs,
      refs_digest (equal sequences have equal digests), status, diagnostics.  A diagnostic of references
      kept from a base comes once for each code, without the reference; expand() tells each.
    objects: kind, key, coordinates and value of the first blob or shape of each identity.
    compactions: boundary, logical_parent_uuid, metadata, before_message, first_following_message,
      first_following_assistant (structs of coordinates, uuid, parent_uuid, type).
    summaries: boundary_line and the coordinates of each summary.
    diagnostics: line_no, code, message, reference.
    """

    requests: DataFrame
    objects: DataFrame
    compactions: DataFrame
    summaries: DataFrame
    diagnostics: DataFrame
    nodes: DataFrame = field(repr=False)
    tails: DataFrame = field(repr=False)
    levels: list[DataFrame] = field(repr=False)

    def expand(self, asked: DataFrame) -> DataFrame:
        """(path, line_no, position, ref, missing, ambiguous): every reference of the requests asked for (path, line_no)."""
        return _expanded(asked, self.nodes, self.tails, self.levels)


def _at(path: str) -> Column:
    return F.try_variant_get("v", path, "variant")


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(path)), F.lit("VOID"))


def _text(path: str) -> Column:
    """A string value; whatever else is there counts as none."""
    return F.when(_kind(path) == "STRING", F.try_variant_get("v", path, "string")).otherwise(F.lit(""))


def _objects(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(firsts: path, kind, key, first_line, conflict_line), objects and diagnostics."""
    payload = F.when(F.col("kind") == BLOB, F.to_json(_at("$.message"))).otherwise(F.to_json(_at("$.shape")))
    o = rows.where(F.col("kind").isin(BLOB, SHAPE)).withColumn("key", F.when(F.col("kind") == BLOB, _text("$.hash")).otherwise(_text("$.shapeHash")))
    o = o.withColumn("payload", F.sha2(F.coalesce(payload, F.lit("null")), 256))
    named = o.where("key <> ''")
    each = named.groupBy("path", "kind", "key", "payload").agg(F.min("line_no").alias("line_no"))
    rank = F.row_number().over(Window.partitionBy("path", "kind", "key").orderBy("line_no"))
    two = each.withColumn("r", rank).where("r <= 2")
    firsts = two.groupBy("path", "kind", "key").agg(F.min("line_no").alias("first_line"), F.max(F.when(F.col("r") == 2, F.col("line_no"))).alias("conflict_line"), F.min_by("payload", "line_no").alias("first_payload"))
    firsts = stored(firsts, "firsts")
    marked = named.join(firsts, ["path", "kind", "key"])
    objects = marked.where("line_no = first_line").select("path", "kind", "key", *COORDINATES, "value")
    other = marked.where("payload <> first_payload").select("path", "line_no", F.lit("duplicate_identity").alias("code"), F.lit("first native object retained").alias("message"), F.col("key").alias("reference"))
    unnamed = o.where("key = ''").select("path", "line_no", F.lit("missing_identity").alias("code"), F.format_string("line %d: %s lacks identity", "line_no", "kind").alias("message"), F.lit(None).cast("string").alias("reference"))
    return firsts, objects, other.unionByName(unnamed)


def _requests(rows: DataFrame) -> DataFrame:
    raw = F.get_json_object("value", "$.keep")
    number = ~_kind("$.keep").isin("STRING", "BOOLEAN", "VOID") & ~_kind("$.keep").startswith("ARRAY") & ~_kind("$.keep").startswith("OBJECT")
    keep = F.when(number & raw.rlike("^[0-9]+$"), raw.try_cast("long"))
    tail = F.when(_kind("$.tail").startswith("ARRAY"), F.from_json(F.get_json_object("value", "$.tail"), "array<variant>"))
    q = rows.where(F.col("kind") == REQUEST).select("path", *COORDINATES, _text("$.id").alias("id"), _text("$.querySource").alias("query_source"), _text("$.shapeHash").alias("shape_hash"), _text("$.base").alias("base"), keep.alias("keep"), tail.alias("tail"))
    texts = F.filter("tail", lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) == "STRING")
    q = q.withColumn("refs", F.coalesce(F.transform(texts, lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")))
    q = q.select("*", F.coalesce(F.size("tail") - F.size("refs"), F.lit(0)).alias("n_odd"), F.col("tail").isNull().alias("no_tail"), F.size("refs").cast("long").alias("n_tail")).drop("tail")
    ids = q.where("id <> ''").groupBy("path", "id").agg(F.min("line_no").alias("first_line"))
    q = q.join(ids, ["path", "id"], "left").withColumn("repeated", F.coalesce(F.col("line_no") > F.col("first_line"), F.lit(False))).drop("first_line")
    named = ids.select("path", F.col("id").alias("base"), F.col("first_line").alias("parent"))
    q = q.join(named, ["path", "base"], "left")
    return stored(q.withColumn("parent", F.when((F.col("keep") > 0) & (F.col("parent") < F.col("line_no")), F.col("parent"))), "requests")


def _copied(q: DataFrame) -> DataFrame:
    """(path, line_no, parent, keep, n_tail): parents that are long enough, with what is kept of them; others have none."""
    above = q.select("path", F.col("line_no").alias("parent"), F.col("n_tail").alias("p_tail"), F.col("keep").alias("p_keep"), F.col("parent").alias("p_parent"))
    j = q.select("path", "line_no", "parent", "keep", "n_tail").join(above, ["path", "parent"], "left")
    short = F.col("keep") > F.when(F.col("p_parent").isNotNull(), F.col("p_keep")).otherwise(0) + F.col("p_tail")
    known = F.when(F.col("parent").isNull(), False).when(F.col("keep") <= F.col("p_tail"), True).when(short, False)
    state = j.select("path", "line_no", F.when(known.isNull(), F.col("parent")).alias("ptr"), known.alias("ok"), "parent", "keep", "n_tail")
    state = climb(stored(state, "ok"), {"ok": lambda own, above: F.coalesce(own, above)})
    ok = F.coalesce("ok", F.lit(False))
    return stored(state.select("path", "line_no", F.when(ok, F.col("parent")).alias("parent"), F.when(ok, F.col("keep")).otherwise(0).alias("keep"), "n_tail"), "nodes")


def _owners(nodes: DataFrame) -> DataFrame:
    """nodes with owner: the nearest ancestor that keeps less, and its keep."""
    above = nodes.select("path", F.col("line_no").alias("parent"), F.col("keep").alias("p_keep"))
    j = nodes.join(above, ["path", "parent"], "left")
    near = j.where("parent is null or p_keep < keep").select("path", "line_no", F.col("parent").alias("owner"))
    far = stored(j.where("p_keep >= keep").select("path", "line_no", "keep", F.col("parent").alias("at")), "far")
    if far.limit(1).count():
        # the lowest keep among the 2^j nearest ancestors, for every j
        level = stored(j.select("path", "line_no", F.col("parent").alias("ptr"), F.col("p_keep").alias("low")).where("ptr is not null"), "low")
        levels = [level]
        while True:
            up = level.select("path", F.col("line_no").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"))
            level = stored(level.join(up, ["path", "ptr"]).select("path", "line_no", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low")), "low")
            if level.limit(1).count() == 0:
                break
            levels.append(level)
        for level in reversed(levels):
            up = level.select("path", F.col("line_no").alias("at"), "ptr", "low")
            step = far.join(up, ["path", "at"], "left")
            far = stored(step.select("path", "line_no", "keep", F.when(F.col("low") >= F.col("keep"), F.col("ptr")).otherwise(F.col("at")).alias("at")), "far")
        last = levels[0].select("path", F.col("line_no").alias("at"), F.col("ptr").alias("owner"))
        near = near.unionByName(far.join(last, ["path", "at"]).select("path", "line_no", "owner"))
    keeps = nodes.select("path", F.col("line_no").alias("owner"), F.col("keep").alias("owner_keep"))
    return stored(nodes.join(near, ["path", "line_no"]).join(keeps, ["path", "owner"], "left").select("path", "line_no", "parent", "keep", "n_tail", "owner", "owner_keep"), "owners")


def _tails(q: DataFrame, nodes: DataFrame, firsts: DataFrame) -> DataFrame:
    """Each reference of each tail with its position in the request, and what the tail holds up to it."""
    blobs = firsts.where(F.col("kind") == BLOB).select("path", F.col("key").alias("ref"), F.col("first_line").alias("seen"), F.col("conflict_line").alias("conflict"))
    each = q.select("path", "line_no", F.posexplode("refs").alias("pos", "ref")).join(blobs, ["path", "ref"], "left")
    each = each.join(nodes.select("path", "line_no", "keep"), ["path", "line_no"]).withColumn("position", F.col("keep") + F.col("pos"))
    upto = Window.partitionBy("path", "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    never = F.lit(_NEVER)
    return stored(each.select(
        "path", "line_no", "pos", "position", "ref", F.coalesce("seen", never).alias("seen"), F.coalesce("conflict", never).alias("conflict"),
        F.max(F.coalesce("seen", never)).over(upto).alias("latest"), F.min(F.coalesce("conflict", never)).over(upto).alias("earliest"), F.bit_xor(F.xxhash64("position", "ref")).over(upto).alias("digest"),
    ), "tails")


_MERGED = {"latest": F.greatest, "earliest": F.least, "digest": lambda a, b: a.bitwiseXOR(b)}
_NOTHING = {"latest": 0, "earliest": _NEVER, "digest": 0}


def _held(nodes: DataFrame, tails: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(path, line_no, latest, earliest, digest) over all references of each request."""
    at = tails.select("path", F.col("line_no").alias("of"), F.col("pos").cast("long").alias("last"), *_MERGED)
    nothing = [F.coalesce(c, F.lit(v)).alias(c) for c, v in _NOTHING.items()]
    edges = nodes.select("path", "line_no", F.col("owner").alias("ptr"), F.col("keep").alias("upto"), F.col("owner").alias("of"), (F.col("keep") - F.col("owner_keep") - 1).alias("last"))
    edges = edges.join(at, ["path", "of", "last"], "left").select("path", "line_no", "ptr", "upto", *nothing)
    prefix = climb(stored(edges, "edges"), _MERGED | {"upto": lambda own, above: above}, levels)
    own = nodes.select("path", F.col("line_no").alias("of"), (F.col("n_tail") - 1).alias("last")).join(at, ["path", "of", "last"], "left").select("path", F.col("of").alias("line_no"), *nothing)
    both = prefix.join(own.select("path", "line_no", *[F.col(c).alias(f"_{c}") for c in _MERGED]), ["path", "line_no"])
    return both.select("path", "line_no", *[f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in _MERGED.items()])


def _expanded(asked: DataFrame, nodes: DataFrame, tails: DataFrame, levels: list[DataFrame]) -> DataFrame:
    n = nodes.select("path", F.col("line_no").alias("node"), "keep", "n_tail")
    pairs = asked.select("path", "line_no", F.col("line_no").alias("node")).join(n, ["path", "node"]).select("path", "line_no", "node", (F.col("keep") + F.col("n_tail")).alias("upto"))
    # owners at every distance: those at distances below 2^(j+1) from those below 2^j, longest jump first
    for level in reversed(levels):
        jump = level.where("ptr is not null").select("path", F.col("line_no").alias("node"), "ptr", F.col("upto").alias("_upto"))
        pairs = stored(pairs, "pairs")  # else the plan doubles at each level
        pairs = pairs.unionByName(pairs.join(jump, ["path", "node"]).select("path", "line_no", F.col("ptr").alias("node"), F.col("_upto").alias("upto")))
    t = tails.select("path", F.col("line_no").alias("node"), "position", "ref", "seen", "conflict")
    out = pairs.join(t, ["path", "node"]).where("position < upto")
    return out.select("path", "line_no", "position", "ref", (F.col("seen") > F.col("line_no")).alias("missing"), (F.col("conflict") < F.col("line_no")).alias("ambiguous"))


def _told(q: DataFrame, nodes: DataFrame, held: DataFrame, firsts: DataFrame, expand: Callable[[DataFrame], DataFrame]) -> DataFrame:
    shapes = firsts.where(F.col("kind") == SHAPE).select("path", F.col("key").alias("shape_hash"), F.col("first_line").alias("shape_line"), F.col("conflict_line").alias("shape_conflict"))
    j = q.drop("parent").join(nodes.select("path", "line_no", "parent", F.col("keep").alias("kept")), ["path", "line_no"]).join(held, ["path", "line_no"]).join(shapes, ["path", "shape_hash"], "left")
    line = F.col("line_no")
    j = j.select(
        "*", (F.col("latest") > line).alias("missing"), (F.col("earliest") < line).alias("ambiguous"),
        (F.coalesce(F.col("shape_line") > line, F.lit(True))).alias("no_shape"), F.coalesce(F.col("shape_conflict") < line, F.lit(False)).alias("odd_shape"),
        F.col("keep").isNull().alias("no_keep"), (F.coalesce(F.col("keep") > 0, F.lit(False)) & F.col("parent").isNull()).alias("no_base"),
    )
    own_bad = (F.col("id") == "") | F.col("odd_shape") | F.col("no_keep") | F.col("no_base") | F.col("no_tail") | (F.col("n_odd") > 0) | F.col("ambiguous") | F.col("repeated")
    j = stored(j.withColumn("own_bad", own_bad), "told")
    bad = climb(stored(j.select("path", "line_no", F.when(~F.col("own_bad"), F.col("parent")).alias("ptr"), F.col("own_bad").alias("bad")), "bad"), {"bad": lambda own, above: own | above}, keep_going=lambda b: ~b)
    above = bad.select("path", F.col("line_no").alias("parent"), F.col("bad").alias("bad_base"))
    j = j.join(above, ["path", "parent"], "left").withColumn("bad_base", F.coalesce("bad_base", F.lit(False)))
    # which of the two comes first among the references counts for the status, where there are both
    both = j.where("missing and ambiguous").select("path", "line_no")
    if both.limit(1).count():
        first = expand(both).where("missing or ambiguous").groupBy("path", "line_no").agg(F.min_by("ambiguous", "position").alias("odd_first"))
        j = j.join(first, ["path", "line_no"], "left")
    else:
        j = j.withColumn("odd_first", F.lit(None).cast("boolean"))

    def said(code: str, message: str, reference: Column | None = None) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), (F.lit(None).cast("string") if reference is None else reference).alias("reference"))

    one = lambda condition, *what: F.when(condition, F.array(said(*what))).otherwise(F.array().cast(_DIAGNOSTICS))
    odd_ref, no_ref = one(F.col("ambiguous"), "unsupported", "duplicate blob identity is ambiguous"), one(F.col("missing"), "missing_blob", "referenced blob is not available")
    diagnostics = F.concat(
        one(F.col("id") == "", "unsupported", "request lacks string id"),
        one(F.col("no_shape"), "missing_shape", "request shape is not available", F.col("shape_hash")),
        one(F.col("odd_shape"), "unsupported", "duplicate shape identity is ambiguous", F.col("shape_hash")),
        one(F.col("no_keep"), "unsupported", "keep must be a nonnegative integer"),
        one(F.col("no_base"), "missing_base", "request base is not available, or shorter than keep", F.col("base")),
        one(F.col("bad_base"), "missing_base", "base reference sequence is incomplete", F.col("base")),
        one(F.col("no_tail"), "unsupported", "tail must be an array"),
        F.array_repeat(said("unsupported", "tail contains a non-string reference"), F.col("n_odd").cast("int")),
        F.when(F.coalesce("odd_first", F.lit(True)), F.concat(odd_ref, no_ref)).otherwise(F.concat(no_ref, odd_ref)),
        one(F.col("repeated"), "unsupported", "duplicate request id; first request remains the base lookup", F.col("id")),
    )
    j = j.withColumn("diagnostics", diagnostics)
    return j.select("path", *COORDINATES, "id", "query_source", "shape_hash", F.col("parent").alias("base_line"), F.col("kept").alias("keep"), (F.col("kept") + F.col("n_tail")).alias("n_refs"), F.col("digest").alias("refs_digest"), F.coalesce(F.get("diagnostics", F.lit(0))["code"], F.lit("complete")).alias("status"), "diagnostics")


def _compactions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    message = F.struct(*COORDINATES, F.col("uuid"), F.col("parent_uuid"), F.col("kind").alias("type"))
    is_boundary, is_message = F.col("boundary"), F.col("kind").isin("user", "assistant")
    r = rows.withColumn("boundary", (F.col("kind") == "system") & (_text("$.subtype") == "compact_boundary")).where(is_boundary | is_message)
    r = r.select("path", *COORDINATES, "kind", "boundary", _text("$.uuid").alias("uuid"), _text("$.parentUuid").alias("parent_uuid"), _text("$.logicalParentUuid").alias("logical_parent_uuid"), F.when(_kind("$.compactMetadata").startswith("OBJECT"), F.to_json(_at("$.compactMetadata"))).alias("metadata"), F.coalesce(F.try_variant_get("v", "$.isCompactSummary", "boolean") & (_kind("$.isCompactSummary") == "BOOLEAN"), F.lit(False)).alias("is_summary"))
    r = stored(r.withColumn("block", F.floor(F.col("line_no") / BLOCK)), "messages")
    # the last boundary and message before each line: inside its block, else what earlier blocks hand on
    last = {"last_boundary": F.when(is_boundary, F.col("line_no")), "last_message": F.when(is_message, F.col("line_no"))}
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = r.groupBy("path", "block").agg(*[F.max(c).alias(n) for n, c in last.items()]).select("path", "block", *[F.max(n).over(earlier).alias(f"_{n}") for n in last])
    inside = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    r = r.select("*", *[F.max(c).over(inside).alias(n) for n, c in last.items()]).join(handed, ["path", "block"])
    r = stored(r.withColumns({n: F.coalesce(n, f"_{n}") for n in last}).drop(*[f"_{n}" for n in last]), "messages")
    said = r.where(~is_boundary & F.col("last_boundary").isNotNull())
    is_assistant = F.col("kind") == "assistant"
    following = said.groupBy("path", F.col("last_boundary").alias("line_no")).agg(F.min_by(message, "line_no").alias("first_following_message"), F.min_by(F.when(is_assistant, message), F.when(is_assistant, F.col("line_no"))).alias("first_following_assistant"))
    before = r.where(~is_boundary).select("path", F.col("line_no").alias("last_message"), message.alias("before_message"))
    found = r.where(is_boundary).withColumn("at", message).join(before, ["path", "last_message"], "left").join(following, ["path", "line_no"], "left")
    compactions = found.select("path", F.col("at").alias("boundary"), "logical_parent_uuid", "metadata", "before_message", "first_following_message", "first_following_assistant")
    ends = following.select("path", F.col("line_no").alias("last_boundary"), F.col("first_following_assistant.line_no").alias("upto"))
    summaries = said.where("is_summary").join(ends, ["path", "last_boundary"]).where("upto is null or line_no <= upto")
    return compactions, summaries.select("path", F.col("last_boundary").alias("boundary_line"), *COORDINATES, "uuid", "parent_uuid", F.col("kind").alias("type"))


def inspect(records: DataFrame) -> Inspection:
    """What the records of native logs (records.records()) tell of requests and compactions.

    Numbers are compared by value, objects whatever the order of their names.  A record
    whose names repeat is no evidence and is left out, as malformed ones are.  No
    records give empty tables.
    """
    rows = records.where("value is not null").withColumn("v", F.try_parse_json("value")).where("v is not null")
    rows = rows.withColumn("kind", _text("$.type")).where(F.col("kind").isin(BLOB, SHAPE, REQUEST, "system", "user", "assistant"))
    firsts, objects, told = _objects(rows)
    q = _requests(rows)
    nodes = _owners(_copied(q))
    tails = _tails(q, nodes, firsts)
    levels: list[DataFrame] = []
    held = stored(_held(nodes, tails, levels), "held")
    requests = _told(q, nodes, held, firsts, lambda asked: _expanded(asked, nodes, tails, levels))
    compactions, summaries = _compactions(rows)
    malformed = records.where("diagnostic is not null").select("path", "line_no", F.col("diagnostic").alias("code"), F.format_string("line %d: %s", "line_no", "diagnostic").alias("message"), F.lit(None).cast("string").alias("reference"))
    return Inspection(requests, objects, compactions, summaries, malformed.unionByName(told), nodes, tails, levels)

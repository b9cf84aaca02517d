"""Fixed schemas: the session document and the ten normalized tables.

Column lists are fixed values of the data model.  Types: s string, i bigint, f double;
a trailing ! marks columns that are never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACTIVITY = "tool_call_record_count:i orchestration_count:i execution_record_count:i file_change_count:i model_invocation_count:i file_touch_count:i confirmed_file_target_count:i"

_SPECS = {
    "sessions": "session_id:s! schema_version:s profile:s scenario_id:s quality:s title:s summary:s classification:s source_format:s source_path:s converted_at:s converter_version:s original_session_id:s for_research:i needs_cleaning:i contains_error:i contains_pii:i category_json:s model:s model_version:s temperature:f tools_enabled_json:s system_prompt:s agent_framework:s agent_version:s platform_type:s provider_hint:s working_directory:s git_branch:s git_ref:s autonomy_level:s sandbox:i framework_config_json:s privacy_level:s duration_seconds:f active_duration_seconds:f started_at:s ended_at:s hour_of_day:i day_of_week:i guidance_variant:s permission_level:s condition_custom_json:s project_id:s predecessor_session:s concurrent_sessions:i human_attention:s outcome_success:i outcome_partial:i failure_codes_json:s outcome_notes:s turn_count:i tool_call_count:i read_count:i modify_count:i create_count:i execute_count:i raw_json:s "
    + _ACTIVITY,
    "turns": "session_id:s! turn_index:i! timestamp:s role:s source:s model:s content_type:s input_channel:s content:s framework_metadata_json:s thinking:s intent_requested:i intent_inferred:i intent_proactive:i was_streamed:i stream_log:s input_tokens:i output_tokens:i cache_read_tokens:i cache_creation_tokens:i reasoning_tokens:i tool_tokens:i raw_json:s",
    "tool_calls": "session_id:s! tool_call_id:s! source_ordinal:i! emitting_turn_index:i timestamp:s tool_name:s operation_type:s file_path:s record_kind:s! command:s justification:s arguments_json:s success:i outcome_status:s output_status:s result:s error:s exit_code:i duration_ms:i truncated:i full_bytes:i full_hash:s full_reference:s redacted:i content_origin:s position_in_session:f tools_before_json:s time_since_last_user:f framework_metadata_json:s spawned_agent_type:s spawned_agent_task_scope:s spawned_agent_sub_session_id:s spawned_agent_outcome_summary:s raw_json:s",
    "turn_tool_calls": "session_id:s! turn_index:i! tool_call_id:s! ordinal:i!",
    "files": "session_id:s! tool_call_id:s! path:s! operation_type:s tool_name:s success:i turn_index:i target_ordinal:i! evidence_kind:s! evidence_status:s! cwd:s resolved:i! native_path:s source_reference:s",
    "annotations": "session_id:s! annotation_id:s! timestamp:s annotator:s scope_type:s target_id:s category:s tags_json:s title:s detail:s minitrace_taxonomy_json:s mast_taxonomy_json:s toolemu_taxonomy_json:s classification:s raw_json:s",
    "handovers": "session_id:s! direction:s! from_session:s to_session:s document:s state_description:s raw_json:s",
    "metrics": "session_id:s! turn_count:i tool_call_count:i read_count:i modify_count:i create_count:i execute_count:i delegate_count:i read_ratio:f time_to_first_action:f idle_ratio:f total_input_tokens:i total_output_tokens:i total_cache_read_tokens:i total_cache_creation_tokens:i total_reasoning_tokens:i total_tool_tokens:i session_cost:f subagent_count:i subagent_tool_calls:i model_switches:i unique_models:i median_response_tokens:i max_response_tokens:i raw_json:s "
    + _ACTIVITY,
    "attachments": "session_id:s! attachment_id:s! timestamp:s kind:s name:s media_type:s path:s url:s size_bytes:i hash:s content_ref:s text_preview:s turn_index:i tool_call_id:s event_id:s framework_metadata_json:s raw_json:s",
    "events": "session_id:s! event_id:s! timestamp:s turn_index:i ordinal:i kind:s role:s tool_call_id:s annotation_id:s attachment_id:s title:s summary:s text:s severity:s collapsed_by_default:i framework_metadata_json:s raw_json:s",
}

_TYPES = {"s": T.StringType(), "i": T.LongType(), "f": T.DoubleType()}


def _struct(spec: str) -> T.StructType:
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, _TYPES[kind[0]], not kind.endswith("!")))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {name: _struct(spec) for name, spec in _SPECS.items()}

KEYS = {
    "sessions": ("session_id",),
    "turns": ("session_id", "turn_index"),
    "tool_calls": ("session_id", "tool_call_id"),
    "turn_tool_calls": ("session_id", "turn_index", "ordinal"),
    "annotations": ("session_id", "annotation_id"),
    "handovers": ("session_id", "direction"),
    "metrics": ("session_id",),
    "attachments": ("session_id", "attachment_id"),
    "events": ("session_id", "event_id"),
}

_FILE_TARGET = "path string, native_path string, operation_type string, evidence_kind string, status string, success boolean, cwd string, resolved boolean, source_reference string"
_HANDOVER = "struct<from_session:string,to_session:string,document:string,state_description:string>"


def _nested(text: str) -> str:
    return "struct<" + ",".join(":".join(p.strip().split(" ", 1)) for p in text.split(", ")) + ">"


#: Free-form values stay JSON text: a string field of a JSON schema keeps the value's text.
SESSION_DDL = f"""
id string, schema_version string, profile string, scenario_id string, quality string, title string, summary string, classification string,
provenance struct<source_format:string,source_path:string,converted_at:string,converter_version:string,original_session_id:string,source_fingerprint:string,identity_basis:string>,
flags struct<for_research:boolean,needs_cleaning:boolean,contains_error:boolean,contains_pii:boolean,category:array<string>>,
environment struct<model:string,model_version:string,temperature:double,tools_enabled:array<string>,system_prompt:string,agent_framework:string,agent_version:string,platform_type:string,provider_hint:string>,
operational_context struct<working_directory:string,git_branch:string,git_ref:string,autonomy_level:string,sandbox:boolean,framework_config:string>,
timing struct<privacy_level:string,duration_seconds:double,active_duration_seconds:double,started_at:string,ended_at:string,hour_of_day:bigint,day_of_week:bigint>,
condition struct<guidance_variant:string,permission_level:string,custom:string>,
coordination struct<project_id:string,predecessor_session:string,concurrent_sessions:bigint,human_attention:string>,
handover struct<received:{_HANDOVER},produced:{_HANDOVER}>,
turns array<struct<index:bigint,timestamp:string,role:string,source:string,model:string,content_type:string,input_channel:string,content:string,framework_metadata:string,tool_calls_in_turn:array<string>,thinking:string,intent_markers:struct<requested:boolean,inferred:boolean,proactive:boolean>,streaming:struct<was_streamed:boolean,stream_log:string>,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_creation_tokens:bigint,reasoning_tokens:bigint,tool_tokens:bigint>>>,
tool_calls array<struct<record_kind:string,id:string,emitting_turn_index:bigint,timestamp:string,tool_name:string,operation_type:string,input:struct<file_targets:array<{_nested(_FILE_TARGET)}>,file_path:string,command:string,justification:string,arguments:string>,output:struct<success:boolean,status:string,result:string,error:string,exit_code:bigint,duration_ms:bigint,truncated:boolean,full_bytes:bigint,full_hash:string,full_reference:string,redacted:boolean,content_origin:string>,context:struct<position_in_session:double,tools_before:array<string>,time_since_last_user:double>,framework_metadata:string,spawned_agent:struct<agent_type:string,task_scope:string,sub_session_id:string,outcome_summary:string>>>,
events array<struct<id:string,timestamp:string,turn_index:bigint,ordinal:bigint,kind:string,role:string,tool_call_id:string,annotation_id:string,attachment_id:string,title:string,summary:string,text:string,severity:string,collapsed_by_default:boolean,framework_metadata:string,raw_json:string>>,
attachments array<struct<id:string,timestamp:string,kind:string,name:string,media_type:string,path:string,url:string,size_bytes:bigint,hash:string,content_ref:string,text_preview:string,turn_index:bigint,tool_call_id:string,event_id:string,framework_metadata:string,raw_json:string>>,
outcome struct<success:boolean,partial:boolean,failure_codes:array<string>,outcome_notes:string>,
annotations array<struct<id:string,timestamp:string,annotator:string,scope:struct<type:string,target_id:string>,content:struct<category:string,tags:array<string>,title:string,detail:string>,taxonomy_mappings:struct<minitrace:array<string>,mast:array<string>,toolemu:array<string>>,classification:string>>,
metrics struct<turn_count:bigint,tool_call_count:bigint,read_count:bigint,modify_count:bigint,create_count:bigint,execute_count:bigint,delegate_count:bigint,read_ratio:double,time_to_first_action:double,idle_ratio:double,total_input_tokens:bigint,total_output_tokens:bigint,total_cache_read_tokens:bigint,total_cache_creation_tokens:bigint,total_reasoning_tokens:bigint,total_tool_tokens:bigint,session_cost:double,subagent_count:bigint,subagent_tool_calls:bigint,model_switches:bigint,unique_models:bigint,median_response_tokens:bigint,max_response_tokens:bigint>
""".strip()


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the columns of a table, cast; what df lacks is null."""
    have = {c.lower(): c for c in df.columns}

    def col(f: T.StructField) -> Column:
        c = F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[col(f) for f in TABLES[table].fields])


def empty(spark) -> dict[str, DataFrame]:
    """All ten tables without rows."""
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}

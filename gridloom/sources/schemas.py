"""Record schemas in Spark DDL; every reader states one, none is inferred."""

GRID = "array<array<int>>"
TASK = f"train array<struct<input:{GRID},output:{GRID}>>, test array<struct<input:{GRID},output:{GRID}>>"
MESSAGES = "array<struct<role:string,content:string>>"
SAMPLING = "struct<temperature:double,top_p:double,max_tokens:int,seed:bigint,use_provider_defaults:boolean>"
USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
AUGMENTATION = "struct<source_trace_id:string,transformation_code:string,value_mapping:string,order_mapping:string,style:string,variant_index:int>"
REQUEST = f"request_id string, task_id string, stage string, messages {MESSAGES}, prompt_version string, hint_mode string, few_shot_task_ids array<string>, sampling {SAMPLING}, augmentation {AUGMENTATION}, metadata map<string,string>"
STATIC = "struct<accepted:boolean,missing_sections:array<string>,sections_in_order:boolean,sections_unique:boolean,single_think_block:boolean,starts_with_think:boolean>"
QUALITY = "struct<accepted:boolean,route:string,pass_count:int,vote_count:int,reviewer_note:string>"
RESULT = f"request_id string, task_id string, stage string, backend string, model string, prompt_version string, hint_mode string, raw_output string, normalized_output string, finish_reason string, usage {USAGE}, error string, validation struct<static:{STATIC},quality:{QUALITY},judge_parse_errors:array<string>>, augmentation {AUGMENTATION}, metadata map<string,string>"
HINT = "schema_version int, task_id string, general string, inputs string, outputs string, transformation string, transformation_steps string"
DECISION = "request_id string, accepted boolean, reviewer_note string"
GUIDANCE = "request_id string, key string, guidance string, trace string, normalized_output string, raw_output string, validation_error string"
PLAN_ROW = "struct<augmented_key:string,task_id:string,transformation_code:string,value_mapping:string,order_mapping:string,variant_index:int>"
PREDICTION = (
    "schema_version int, kind string, request_id string, task_id string, test_index int, variant struct<key:string,task_id:string,is_augmented:boolean,transformation_code:string,value_mapping:string,order_mapping:string,variant_index:int>, "
    "protocol string, guidance_mode string, guidance_key string, adapter_used boolean, prompt_sha256 string, prompt_token_count bigint, sample_count int, "
    "outputs array<struct<sample_index:int,text:string,generated_token_count:bigint,finish_reason:string,stop_reason:string>>"
)

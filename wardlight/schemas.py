"""Input schemas at the boundaries."""

from __future__ import annotations

RAW_DATA = (
    "struct<to_removable_media:boolean,from_removable_media:boolean,shadow_it_category:string,"
    "device_managed:int,has_admin_rights:int,security_training_current:int,auth_method:string,"
    "network_zone:string,is_shadow_it:int,sanction_status:string,external_recipient:boolean,"
    "is_departing_employee:int,scenario_id:string,threat_scenario:string,policy_violation:int,"
    "app_name_original:string>"
)

UNIFIED_EVENT = (
    "event_id string, timestamp timestamp, agent_id string, hostname string, username string, "
    f"client_id string, event_type string, source string, raw_data {RAW_DATA}, "
    "destination_ip string, destination_domain string, destination_port int, bytes_sent bigint, "
    "bytes_received bigint, mac_address string, device_status string, file_path string, "
    "file_name string, file_size_kb double, file_extension string, app_name string, "
    "app_version string, app_publisher string, risk_score double, risk_category string, "
    "risk_reasons array<string>, is_anomaly boolean, mitre_tags array<string>"
)

SIEM_ALERT = (
    "id string, timestamp string, "
    "rule struct<id:string,level:int,description:string,groups:array<string>,"
    "mitre:struct<id:array<string>>>, "
    "agent struct<id:string,name:string>, "
    "data struct<win:struct<eventdata:struct<user:string,queryName:string,image:string>>,"
    "dstuser:string,srcuser:string>, full_log string"
)
SIEM_HIT = (
    "_id string, "
    "_source struct<id:string,timestamp:string,"
    "rule:struct<id:string,level:int,description:string,groups:array<string>,mitre:struct<id:array<string>>>,"
    "agent:struct<id:string,name:string>,"
    "data:struct<win:struct<eventdata:struct<user:string,queryName:string,image:string>>,"
    "dstuser:string,srcuser:string>,full_log:string>"
)

CANONICAL_LINE = (
    "schema_version string, tenant_id string, event_id string, occurred_at string, "
    "user_id string, device_id string, source string, event_type string, metadata string"
)

COLLECTOR_LINE = (
    "timestamp string, kind string, user string, device string, domain string, "
    "duration_seconds bigint, publisher string, product string, version string, "
    "bytes_transferred bigint, classification string, detectors array<string>, match_count int"
)

CATALOGUE = (
    "name string, domain string, publisher string, category string, approval_state string, "
    "risk_weight int"
)

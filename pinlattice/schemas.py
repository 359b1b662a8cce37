"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

PIN = "struct<name:string,version:string>"
SPEC = (
    f"struct<package_a:{PIN},package_b:{PIN},python_version:string,os:string,architecture:string>"
)
WHEEL = (
    "struct<filename:string,url:string,size:bigint,sha256:string,python_tag:string,"
    "abi_tag:string,platform_tag:string,has_native_extensions:boolean,uploaded_at:string,"
    "yanked:boolean,compatible:boolean,compatibility_reason:string>"
)
INSTALLED = (
    "struct<package:string,version:string,filename:string,url:string,size:bigint,sha256:string,"
    "python_tag:string,abi_tag:string,platform_tag:string,top_level:boolean>"
)
STAGE = (
    "struct<stage:string,command:array<string>,exit_code:int,duration_seconds:double,"
    "stdout:string,stderr:string,timed_out:boolean,peak_rss_bytes:bigint>"
)
CACHE = "struct<size_bytes:bigint>"
MACHINE = (
    "struct<cpu_count:int,memory_total_bytes:bigint,disk_free_bytes:bigint,"
    "network_received_bytes:bigint,network_transmitted_bytes:bigint>"
)
RESOURCES = (
    f"struct<machine_before:{MACHINE},machine_after:{MACHINE},cache_state_before:string,"
    f"cache_before:{CACHE},cache_after:{CACHE},peak_stage_rss_bytes:bigint,"
    "host_network_received_change_bytes:bigint,host_network_transmitted_change_bytes:bigint>"
)
RUNTIME = (
    "struct<python_version:string,os:string,architecture:string,kernel:string,libc:string,"
    "tool_version:string>"
)
OBSERVATION = (
    f"schema_version string, experiment_id string, spec {SPEC}, outcome string, "
    "measured boolean, started_at string, duration_seconds double, normalized_error string, "
    f"exception_type string, stages array<{STAGE}>, wheel_artifacts array<{WHEEL}>, "
    f"installed_wheel_artifacts array<{INSTALLED}>, "
    f"installed_environment array<string>, artifact_lock_sha256 string, runtime {RUNTIME}, "
    f"resources {RESOURCES}"
)
RELEASE = (
    "struct<name:string,version:string,requires_python:string,requires_dist:array<string>,"
    "extras:array<string>,classifiers:array<string>,project_urls:map<string,string>,"
    f"release_date:string,yanked:boolean,wheels:array<{WHEEL}>>"
)
CATALOG = f"target struct<python_version:string>, release {RELEASE}"
RAW_FILE = (
    "struct<packagetype:string,filename:string,url:string,size:bigint,"
    "digests:struct<sha256:string>,upload_time_iso_8601:string,upload_time:string,"
    "yanked:boolean,requires_python:string>"
)
RAW_INFO = (
    "struct<name:string,version:string,requires_python:string,requires_dist:array<string>,"
    "provides_extra:array<string>,classifiers:array<string>,project_urls:map<string,string>,"
    "yanked:boolean>"
)
RAW_RELEASE = f"info {RAW_INFO}, urls array<{RAW_FILE}>"
RAW_PROJECT = f"info struct<name:string>, releases map<string,array<{RAW_FILE}>>"
RAW_RANKING = "rows array<struct<project:string,download_count:bigint>>"
COVERAGE_DETAIL = "struct<python:string,eligible:boolean,reason:string,compatible_wheels:int>"
# A version entry is an object or a bare string, so entries are read as text first.
SCOPE_PACKAGE = "struct<role:string,split:string,versions:array<string>>"
SCOPE_VERSION = (
    f"struct<version:string,coverage:array<boolean>,coverage_details:array<{COVERAGE_DETAIL}>>"
)
FAMILY = "struct<name:string,package_a:string,package_b:string,split:string>"
PLAN_PACKAGE = "struct<role:string,split:string,minimum_versions:int>"
EXPERIMENT = (
    "struct<family:string,package_a:string,package_b:string,python:string,"
    "platform:string,selection_method:string>"
)
MANIFEST = (
    f"shard_index int, shard_count int, experiments array<{EXPERIMENT}>"
)
EMBEDDING = (
    "package string, version string, selected_text_sha256 string, model string, "
    "dimensions int, embedding array<double>"
)
SIGNALS = "package string, version string, version_section_found boolean, text string"

"""Schemas of captured requests, manifests, reports and statuses, as DDL. None is ever inferred."""

REQUEST = "id string, timestamp timestamp, method string, path string, headers map<string,array<string>>, body binary, contentLength bigint, protocol string, metadata map<string,string>"
REQUEST_COLUMNS = ["id", "timestamp", "method", "path", "headers", "body", "contentLength", "protocol", "metadata"]
RESULT = "request_id string, status_code int, duration_ns bigint, error string, response_bytes bigint, timestamp timestamp"
MANIFEST = "formatVersion int, captureID string, recordCount bigint, sha256 string, shardIndex int, shardCount int, sourceCaptureID string, createdAt timestamp"
REPORT = "totalRequests bigint, sentRequests bigint, failedRequests bigint, filteredRequests bigint, durationMs bigint, achievedRPS double, meanLatencyMs bigint, p50LatencyMs bigint, p95LatencyMs bigint, p99LatencyMs bigint"
SCRIPT_EXPORT = "metrics map<string,map<string,double>>"
CALL_REPORT = "count bigint, average double, rps double, latencyDistribution array<struct<percentage:int,latency:double>>, errorDistribution map<string,bigint>"
HEARTBEAT = "spoke_id string, cell string, ts timestamp, captures array<struct<namespace:string,name:string,phase:string,requests:bigint>>, replays array<struct<load_test:string,shard:int,phase:string,sent:bigint>>, complete boolean"

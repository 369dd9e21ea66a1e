"""Column functions: hashes, headers, hosts, durations, paths. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Credential headers that are redacted by default; headers of one hop only.
CREDENTIAL_HEADERS = ("authorization", "cookie", "set-cookie", "proxy-authorization", "x-api-key", "x-auth-token")
HOP_HEADERS = ("connection", "keep-alive", "proxy-connection", "transfer-encoding", "trailer", "upgrade", "host", "content-length")
HEADERS = "map<string,array<string>>"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fnv(text: Column | str, finish) -> Column:
    """finish of the unsigned FNV-1a of the UTF-8 bytes as struct(hi, lo) of 32 bits each, so that no product leaves a long."""
    n = F.octet_length(col(text))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(3421674724).cast("long").alias("hi"), F.lit(2216829733).cast("long").alias("lo"))

    def of(letters: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            x = a["lo"].bitwiseXOR(F.ascii(F.substring(letters, i, F.lit(1))).cast("long"))
            low = x * 435  # the prime is 2**40 + 435
            high = a["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8)
            return F.struct(high.bitwiseAND(MASK).alias("hi"), low.bitwiseAND(MASK).alias("lo"))

        return F.aggregate(places, start, step, finish)

    # A character for each byte, bound once for all steps.
    return F.transform(F.array(F.decode(F.encode(col(text), "utf-8"), "iso-8859-1")), of)[0]


def fnv1a64(text: Column | str) -> Column:
    return _fnv(text, lambda h: h)


def fnv1a64_mod(text: Column | str, n: int) -> Column:
    return _fnv(text, lambda h: (((h["hi"] % n) * ((1 << 32) % n) + h["lo"] % n) % n).cast("int"))


def canonical_header(name: Column | str) -> Column:
    return F.array_join(F.transform(F.split(col(name), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "-")


def header_has(headers: Column | str, name: str, value: str) -> Column:
    """Any header of that name, in any case, has exactly that value. No headers: false."""
    found = F.exists(F.map_entries(col(headers)), lambda e: (F.lower(e["key"]) == name.lower()) & F.array_contains(e["value"], value))
    return F.coalesce(found, F.lit(False))


def headers_match(headers: Column | str, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for name, value in pairs:
        out = out & header_has(headers, name, value)
    return out


def redact(headers: Column | str, names: list[str]) -> Column:
    """Every value of the named headers becomes a mark; names stay and are compared in any case."""
    hidden = [n.lower() for n in names]
    if not hidden:
        return col(headers)
    return F.transform_values(col(headers), lambda k, v: F.when(F.lower(k).isin(hidden), F.transform(v, lambda _: F.lit("[REDACTED]"))).otherwise(v))


def redaction_list(setting: str) -> list[str]:
    """'' means the defaults, 'none' nothing, else the defaults and a comma list."""
    if setting.strip().lower() == "none":
        return []
    return list(dict.fromkeys([*CREDENTIAL_HEADERS, *(x.strip().lower() for x in setting.split(",") if x.strip())]))


def rewrite_headers(headers: Column | str, put: dict[str, str], add: dict[str, str], remove: list[str]) -> Column:
    """Removes, then sets (one value), then adds (appends); names are compared as they are."""
    h = F.coalesce(col(headers), F.create_map().cast(HEADERS))
    gone = [*remove, *put]
    if gone:
        h = F.map_filter(h, lambda k, _: ~k.isin(gone))
    if put:
        h = F.map_concat(h, F.create_map(*[x for k, v in put.items() for x in (F.lit(k), F.array(F.lit(v)))]))
    for k, v in add.items():
        old = F.coalesce(F.try_element_at(h, F.lit(k)), F.array().cast("array<string>"))
        h = F.map_concat(F.map_filter(h, _other_than(k)), F.create_map(F.lit(k), F.concat(old, F.array(F.lit(v)))))
    return h


def _other_than(name: str):
    return lambda k, _: k != name


def outbound_headers(headers: Column | str, request_id: Column | str, override: dict[str, str] | None = None) -> Column:
    """Headers as they are sent: none of one hop only, overrides set, a mark and the request's id."""
    h = F.map_filter(F.coalesce(col(headers), F.create_map().cast(HEADERS)), lambda k, _: ~F.lower(k).isin(*HOP_HEADERS))
    marks = {**(override or {}), "X-Replay": "true"}
    h = F.map_filter(h, lambda k, _: ~F.lower(k).isin(*[x.lower() for x in marks], "x-request-id"))
    return F.map_concat(h, F.create_map(*[x for k, v in marks.items() for x in (F.lit(k), F.array(F.lit(v)))], F.lit("X-Request-Id"), F.array(col(request_id))))


def host_allowed(host: Column | str, patterns: list[str]) -> Column:
    """No patterns allow all; else an exact host or, for '*.suffix', one below it. Blank patterns allow nothing."""
    if not patterns:
        return F.lit(True)
    h = F.regexp_replace(F.lower(F.trim(col(host))), r"\.$", "")
    out = F.lit(False)
    for p in (p.strip().lower().rstrip(".") for p in patterns):
        if p.startswith("*."):
            out = out | (h.endswith(p[1:]) & (h != p[1:]))
        elif p:
            out = out | (h == p)
    return out


def target_url(host: Column | str, port: Column | str, tls: Column | str) -> Column:
    p = F.coalesce(col(port), F.when(col(tls), F.lit(443)).otherwise(F.lit(80)))
    return F.concat(F.when(col(tls), "https://").otherwise("http://"), col(host), F.lit(":"), p.cast("string"))


def join_url(base: Column | str, path: Column | str) -> Column:
    return F.concat(F.regexp_replace(col(base), "/+$", ""), col(path))


def trim_slashes(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "^/+|/+$", "")


def object_prefix(prefix: Column | str, capture_id: Column | str) -> Column:
    p = F.concat_ws("/", *[F.when(trim_slashes(x) != "", trim_slashes(x)) for x in (prefix, capture_id)])
    return F.when(p == "", "").otherwise(F.concat(p, F.lit("/")))


def split_capture_id(capture_id: Column | str) -> Column:
    """namespace and name, cut at the first slash; without one the namespace is empty."""
    c = col(capture_id)
    at = F.instr(c, "/")
    return F.struct(F.when(at > 0, F.substring_index(c, "/", 1)).otherwise("").alias("namespace"), F.when(at > 0, F.substr(c, at + 1)).otherwise(c).alias("name"))


def object_key(capture_id: Column | str, day: Column | str, pod: Column | str, seq: Column | str) -> Column:
    pod = F.when(F.trim(F.coalesce(col(pod), F.lit(""))) == "", "unknown-agent").otherwise(col(pod))
    return F.concat(trim_slashes(capture_id), F.lit("/"), col(day), F.lit("/"), pod, F.lit("-"), F.lpad(col(seq).cast("string"), 6, "0"), F.lit(".jsonl.gz"))


def parse_object_key(key: Column | str) -> Column:
    """capture_id, day, pod and seq of an object's key; parts that aren't there are null."""
    part = lambda i: F.nullif(F.regexp_extract(col(key), r"^(?:(.*?)/)?(\d{4}-\d{2}-\d{2})/(.+)-(\d{6,})\.jsonl\.gz$", i), F.lit(""))
    return F.struct(part(1).alias("capture_id"), F.try_to_date(part(2), "yyyy-MM-dd").alias("day"), part(3).alias("pod"), part(4).cast("long").alias("seq"))


#: Nanoseconds of a duration's units.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def duration_ns(text: Column | str) -> Column:
    """Nanoseconds of a duration such as 1h2m3.5s or -42ms; null if it isn't one."""
    t = F.trim(col(text))
    one = r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)"
    parts = F.arrays_zip(F.regexp_extract_all(t, F.lit(one), 1).alias("n"), F.regexp_extract_all(t, F.lit(one), 2).alias("u"))
    unit = F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"].cast("double") * unit[p["u"]])
    signed = F.when(t.startswith("-"), -total).otherwise(total)
    return F.when(t.rlike(f"^[-+]?(?:{one})+$"), F.round(signed).cast("long")).when(t.isin("0", "+0", "-0"), F.lit(0).cast("long"))


def latency_text(ms: Column | str) -> Column:
    """42ms, 1.5s, 1m0s, 1h2m3.004s."""
    m = col(ms).cast("long")
    whole = lambda c: F.floor(c).cast("string")
    fine = F.regexp_replace(F.format_string("%.3f", (m % 60_000) / 1000), r"\.?0+$", "")
    s = F.concat(F.when(fine == "", "0").otherwise(fine), F.lit("s"))
    minutes, hours = F.concat(whole(m / 60_000 % 60), F.lit("m")), F.concat(whole(m / 3_600_000), F.lit("h"))
    return F.when(m == 0, "0s").when(m < 1000, F.concat(m.cast("string"), F.lit("ms"))).when(m < 60_000, s).when(m < 3_600_000, F.concat(minutes, s)).otherwise(F.concat(hours, minutes, s))


def parse_pairs(text: Column | str) -> Column:
    """Map of 'k=v,k=v': cut at the first '=', trimmed, items without '=' left out; the last of equals counts."""
    items = F.filter(F.transform(F.split(col(text), ","), lambda x: F.trim(x)), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, last(k))))


def header_filters(text: Column | str) -> Column:
    """filters (name, value) of a JSON array and the fault that it has: not JSON, or a filter without a name. Blank text has none."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    parsed = F.from_json(t, "array<struct<name:string,value:string>>")
    found = F.when(t == "", F.array().cast("array<struct<name:string,value:string>>")).otherwise(parsed)
    nameless = F.exists(found, lambda f: F.trim(F.coalesce(f["name"], F.lit(""))) == "")
    return F.struct(found.alias("filters"), F.when(found.isNull(), "not JSON").when(nameless, "name is required").alias("fault"))


def rate_mode(text: Column | str) -> Column:
    """original, constant or unlimited by the names that are known, in any case; else null."""
    t = F.lower(col(text))
    return F.when(t.isin("original", "recorded"), "original").when(t == "constant", "constant").when(t.isin("unlimited", "max"), "unlimited")


def relative_age(seconds: Column | str) -> Column:
    s = col(seconds).cast("long")
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit + " ago"))
    return F.when(s < 60, ago(1, "s")).when(s < 3600, ago(60, "m")).otherwise(ago(3600, "h"))


def status_class(code: Column | str) -> Column:
    return F.when(col(code) > 0, F.concat(F.floor(col(code) / 100).cast("string"), F.lit("xx"))).otherwise("none")


def error_category(text: Column | str) -> Column:
    t = F.lower(col(text))
    return (
        F.when(t.isNull() | (t == ""), "").when(t.contains("canceled"), "canceled").when(t.contains("deadline exceeded"), "deadline_exceeded")
        .when(t.contains("timeout"), "timeout").when((t == "eof") | t.endswith(": eof"), "connection_closed").otherwise("unknown")
    )


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))

"""Registered queries of the web-archive part, each with SQL that computes the same from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as wf
from ..functions import http
from ..functions import values as v
from ..operators import canonicalize, digests, export, grammar, graph, lint, merge, rewrite, semantic, validate
from ..operators.render import build, exchange, render, revisit_original
from ..operators.restate import to_raw
from ..sources.warc import invalid_reason, read_warc, write_one, write_warc
from ..storage import new_folder
from . import synth
from .synth import PER_FILE, as_raw, captured, captures, day, field_list, key, spread, table, urn

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql_urn(k: str) -> str:
    return f"('urn:uuid:' || regexp_replace(md5({k}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5'))"


def sql_day(c: str) -> str:
    return f"strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({c}), '%Y-%m-%dT%H:%M:%SZ')"


NL = "chr(13) || chr(10)"
HEAD = f"'HTTP/1.1 200 OK' || {NL} || 'Content-Type: text/html' || {NL} || {NL}"
RESPONSE = f"({HEAD} || html)"
REQUEST = f"('GET / HTTP/1.1' || {NL} || 'Host: ' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || {NL} || {NL})"
METADATA = f"('fetchTimeMs: ' || (page_id % 97 + 3)::VARCHAR || {NL})"
INFO = (f"('format: WARC File Format 1.1' || {NL} || 'conformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/' || {NL}"
        f" || 'software: websilo/1.0' || {NL} || 'operator: Ada <ada@example.org>' || {NL})")
RECORDS = f"""
  SELECT 'request' AS record_type, {sql_urn("'q' || page_id::VARCHAR")} AS record_id, page_id, url AS target_uri, {REQUEST} AS body FROM pages
  UNION ALL SELECT 'response', {sql_urn("'r' || page_id::VARCHAR")}, page_id, url, {RESPONSE} FROM pages
  UNION ALL SELECT 'metadata', {sql_urn("'m' || page_id::VARCHAR")}, page_id, url, {METADATA} FROM pages
  UNION ALL SELECT 'warcinfo', {sql_urn("'i' || (page_id // 50)::VARCHAR")}, min(page_id), NULL, {INFO} FROM pages GROUP BY page_id // 50
"""


def loose(rendered):
    """Rendered records without a place in a file, as raw records."""
    return synth.settled(rendered.select(
        F.lit("x").alias("file"), F.lit(0).cast("long").alias("record_index"), "version", "headers", "content_length", "body", grammar.no_error().alias("error")))


def records(raw):
    return semantic.to_semantic(grammar.to_untyped(raw))


def headers_of(raw):
    """The semantic level without blocks' rules."""
    return semantic.to_semantic_header(grammar.to_untyped(raw))


@query(f"SELECT record_type, count(*) AS n, sum(strlen(body))::BIGINT AS bytes FROM ({RECORDS}) GROUP BY record_type")
def scan_summary(spark, sf_dir):
    """Records by type, through archive bytes."""
    return headers_of(captured(spark, sf_dir)).groupBy("record_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body").cast("long")).alias("bytes"))


@query(f"SELECT record_id, sha256(body) AS block FROM ({RECORDS})")
def scan_plain_bodies(spark, sf_dir):
    """Blocks, through an archive without compression."""
    raw = captured(spark, sf_dir, compression="none")
    return raw.select(merge.normal_id(grammar.get("WARC-Record-ID")).alias("record_id"), F.sha2("body", 256).alias("block"))


@query(f"SELECT count(*) AS members, count(*) AS records, 1::BIGINT AS most FROM ({RECORDS})")
def scan_gzip_members(spark, sf_dir):
    """Every gzip member holds one record."""
    from ..sources.warc import gzip_members

    m = gzip_members(spark, synth.archive(spark, sf_dir))
    return m.agg(F.count(F.lit(1)).alias("members"), F.sum("n_records").alias("records"), F.max("n_records").alias("most"))


@query("""SELECT name, count(*) AS n FROM (
  SELECT unnest(CASE t WHEN 0 THEN ['WARC-Type','WARC-Target-URI','WARC-Date','WARC-Record-ID','WARC-Warcinfo-ID','WARC-Payload-Digest','WARC-Block-Digest','Content-Type','Content-Length']
    WHEN 1 THEN ['WARC-Type','WARC-Target-URI','WARC-Date','WARC-Record-ID','WARC-Warcinfo-ID','WARC-Concurrent-To','WARC-IP-Address','WARC-Payload-Digest','WARC-Block-Digest','Content-Type','Content-Length']
    ELSE ['WARC-Type','WARC-Target-URI','WARC-Date','WARC-Record-ID','WARC-Warcinfo-ID','WARC-Concurrent-To','WARC-Block-Digest','Content-Type','Content-Length'] END) AS name
  FROM pages, (SELECT unnest([0, 1, 2]) AS t)
  UNION ALL SELECT unnest(['WARC-Type','WARC-Date','WARC-Record-ID','WARC-Filename','WARC-Block-Digest','Content-Type','Content-Length']) FROM (SELECT DISTINCT page_id // 50 FROM pages)
) GROUP BY name""")
def scan_header_names(spark, sf_dir):
    """Header fields by name, reading no blocks."""
    raw = captured(spark, sf_dir, bodies=False)
    return raw.select(F.explode("headers").alias("h")).groupBy(F.col("h")["name"].alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT record_id, target_uri FROM ({RECORDS}) WHERE record_type = 'response' AND NOT regexp_matches(target_uri, '^[^:]+://[^?#]*/(1|2|25|100)([?#].*)?$')")
def filter_uri_segment(spark, sf_dir):
    """Responses whose last path segment isn't in a list."""
    raw = grammar.where_type(as_raw(captures(spark, sf_dir)), "response")
    return grammar.where_last_segment_not(headers_of(raw), F.col("target_uri"), ["1", "2", "25", "100"]).select("record_id", "target_uri")


@query(f"""SELECT {sql_urn("'r' || page_id::VARCHAR")} AS record_id, {sql_urn("'q' || page_id::VARCHAR")} AS other FROM pages
UNION ALL SELECT {sql_urn("'m' || page_id::VARCHAR")}, {sql_urn("'r' || page_id::VARCHAR")} FROM pages""")
def header_concurrent_to(spark, sf_dir):
    """Every value of a repeatable field."""
    return headers_of(as_raw(captures(spark, sf_dir))).select("record_id", F.explode("concurrent_to").alias("other"))


_STAMP = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id)"


@query(f"""SELECT event_id, CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'minute' WHEN 4 THEN 'second' WHEN 5 THEN 'fraction' END AS precision,
  CASE k WHEN 0 THEN strftime({_STAMP}, '%Y') WHEN 1 THEN strftime({_STAMP}, '%Y-%m') WHEN 2 THEN strftime({_STAMP}, '%Y-%m-%d') WHEN 3 THEN strftime({_STAMP}, '%Y-%m-%dT%H:%MZ')
    WHEN 4 THEN strftime({_STAMP}, '%Y-%m-%dT%H:%M:%SZ') WHEN 5 THEN strftime({_STAMP}, '%Y-%m-%dT%H:%M:%S') || '.' || lpad((event_id % 1000)::VARCHAR, 3, '0') || 'Z' END AS shown,
  CASE WHEN k = 5 THEN (event_id % 1000) * 1000000 WHEN k < 5 THEN 0 ELSE -1 END::INTEGER AS nanos FROM (SELECT event_id, event_id % 7 AS k FROM events)""")
def value_dates(spark, sf_dir):
    """Dates of all precisions, and layouts that are none."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 7
    full = day("event_id")
    cut = lambda n, tail="": F.concat(F.substring(full, 1, n), F.lit(tail))
    text = (F.when(k == 0, cut(4)).when(k == 1, cut(7)).when(k == 2, cut(10)).when(k == 3, cut(16, "Z")).when(k == 4, full)
            .when(k == 5, F.concat(cut(19), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("Z"))).otherwise(cut(13)))
    d = e.select("event_id", v.date(text).alias("d"))
    return d.select("event_id", F.col("d")["precision"].alias("precision"), v.show_date(F.col("d")).alias("shown"), F.coalesce(F.col("d")["nanos"], F.lit(-1)).alias("nanos"))


@query("""SELECT doc_id, sha1(coalesce(text, '')) AS hex, md5(coalesce(text, '')) AS md5_hex, true AS equal_keys FROM documents""")
def value_digest_encodings(spark, sf_dir):
    """Digests in hex, Base32 and Base64 with equal keys, decoded again."""
    d = table(spark, sf_dir, "documents").withColumn("b", F.coalesce("text", F.lit("")).cast("binary"))
    raw = v.computed(F.lit("sha1"), F.col("b"))
    d = d.select("doc_id", "b", v.digest(F.concat(F.lit("SHA-1:"), v.base32(raw))).alias("a"), v.digest(F.concat(F.lit("sha1:"), F.hex(raw))).alias("c"),
                 v.digest(F.concat(F.lit("sha1:"), F.base64(raw))).alias("e"), v.digest(F.concat(F.lit("md5:"), F.md5("b"))).alias("m"))
    return d.select("doc_id", F.lower(F.hex(v.decoded(F.col("a")))).alias("hex"), F.lower(F.hex(v.decoded(F.col("m")))).alias("md5_hex"),
                    ((v.digest_key(F.col("a")) == v.digest_key(F.col("c"))) & (v.digest_key(F.col("c")) == v.digest_key(F.col("e")))).alias("equal_keys"))


@query("""SELECT event_id, CASE k WHEN 0 THEN 'text' WHEN 1 THEN 'Application' WHEN 2 THEN 'text' END AS type, CASE k WHEN 0 THEN 'html' WHEN 1 THEN 'HTTP' WHEN 2 THEN 'plain' END AS subtype,
  CASE k WHEN 0 THEN event_type WHEN 1 THEN 'response' WHEN 2 THEN 'a;"b' END AS first_value,
  CASE k WHEN 3 THEN 'no media type: `/` is missing in `' || event_type || '`' WHEN 4 THEN 'no media type: in `a b/c` type or subtype is no token' END AS why
FROM (SELECT event_id, event_type, event_id % 5 AS k FROM events)""")
def value_media_types(spark, sf_dir):
    """Media types with plain and quoted parameters, and what isn't one."""
    k = F.col("event_id") % 5
    text = (F.when(k == 0, F.concat(F.lit("text/html; Charset="), F.col("event_type"))).when(k == 1, "Application/HTTP; msgtype=response")
            .when(k == 2, 'text/plain ;x="a;\\"b"').when(k == 3, F.col("event_type")).otherwise("a b/c"))
    e = table(spark, sf_dir, "events").select("event_id", v.media_type(text).alias("m"), v.media_type_error(text).alias("why"))
    m = F.col("m")
    return e.select("event_id", m["type"].alias("type"), m["subtype"].alias("subtype"), F.try_element_at(m["parameters"], F.lit(1))["value"].alias("first_value"), "why")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN -1 ELSE length(h)::INTEGER END AS n_hops, h = '' AS is_seed,
  CASE WHEN event_id % 4 = 3 THEN '`x` at byte ' || length(h0)::VARCHAR || ' is the letter of no hop.' END AS error,
  CASE event_id % 3 WHEN 0 THEN 'identical-payload-digest' WHEN 1 THEN 'server-not-modified' ELSE 'other' END AS profile
FROM (SELECT event_id, repeat('LEXRPIMS', (event_id % 3)::INTEGER) AS h0, CASE WHEN event_id % 4 = 3 THEN repeat('LEXRPIMS', (event_id % 3)::INTEGER) || 'x' ELSE repeat('LEXRPIMS', (event_id % 3)::INTEGER) END AS h FROM events)""")
def value_hops_profiles(spark, sf_dir):
    """Hop paths, and revisit profiles."""
    from ..schema import IDENTICAL, NOT_MODIFIED

    i = F.col("event_id")
    path = F.concat(F.repeat(F.lit("LEXRPIMS"), (i % 3).cast("int")), F.when(i % 4 == 3, "x").otherwise(""))
    uri = F.when(i % 3 == 0, IDENTICAL[1]).when(i % 3 == 1, NOT_MODIFIED[0]).otherwise("http://example.org/warc/0.18/revisit")
    e = table(spark, sf_dir, "events").select("event_id", v.hops(path).alias("h"), v.revisit_profile(uri).alias("profile"))
    h = F.col("h")
    return e.select("event_id", F.when(h["error"].isNull(), F.size(h["hops"])).otherwise(-1).alias("n_hops"), h["is_seed"].alias("is_seed"), h["error"].alias("error"), "profile")


def is_type(*types):
    return F.coalesce(F.lower(v.trim_space(v.latin(grammar.get("WARC-Type")))).isin(*types), F.lit(False))


def faulty(spark, sf_dir):
    """All records; the responses have one fault each, by the place of their page in its file."""
    raw = as_raw(captures(spark, sf_dir))
    k = F.floor((F.col("record_index") - 1) / 3) % 9
    line = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(" " + t).cast("binary").alias("value"))
    drop = lambda n: F.filter("headers", lambda h: F.lower(h["name"]) != n.lower())
    add = lambda *ls: F.concat("headers", F.array(*[line(*x) for x in ls]))
    swap = lambda n, t: F.concat(drop(n), F.array(line(n, t)))
    headers = (F.when(k == 0, drop("WARC-Target-URI")).when(k == 1, add(("WARC-Filename", "x"))).when(k == 2, add(("warc-date", "2024-01-01T00:00:00Z")))
               .when(k == 3, swap("WARC-Date", "2024-13-01")).when(k == 4, swap("WARC-Type", "nonsense")).when(k == 5, swap("WARC-Block-Digest", "sha1"))
               .when(k == 6, drop("WARC-Record-ID")).when(k == 7, add(("WARC-Segment-Number", "2"))).otherwise(F.col("headers")))
    return raw.withColumn("headers", F.when(is_type("response"), headers).otherwise(F.col("headers")))


@query("""SELECT CASE k WHEN 0 THEN 'MissingField' WHEN 1 THEN 'ForbiddenField' WHEN 2 THEN 'RepeatedField' WHEN 3 THEN 'MalformedField' WHEN 4 THEN 'UnknownRecordType'
  WHEN 5 THEN 'MalformedField' WHEN 6 THEN 'MissingField' WHEN 7 THEN 'MalformedField' END AS code,
  CASE k WHEN 0 THEN 'Required: `WARC-Target-URI` is absent.' WHEN 1 THEN 'The `WARC-Filename` has no place on a `response` record.'
  WHEN 2 THEN 'The `WARC-Date` occurs more than once.' WHEN 3 THEN 'WARC-Date: not a timestamp: 2024-13-01'
  WHEN 4 THEN 'The `nonsense` record type is unknown.'
  WHEN 5 THEN 'WARC-Block-Digest: no labelled digest: `:` is missing in `sha1`'
  WHEN 6 THEN 'Required: `WARC-Record-ID` is absent.' WHEN 7 THEN 'The value of `WARC-Segment-Number` must not be `2`.' END AS message,
  count(*) AS n FROM (SELECT (page_id % 50) % 9 AS k FROM pages UNION ALL SELECT 8 FROM pages, (SELECT unnest([1, 3])) UNION ALL SELECT 8 FROM pages GROUP BY page_id // 50) GROUP BY ALL""")
def lift_errors(spark, sf_dir):
    """Faults of each level, by their messages."""
    out = headers_of(faulty(spark, sf_dir))
    return out.groupBy(F.col("error")["code"].alias("code"), F.col("error")["message"].alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT record_id, CASE record_type WHEN 'request' THEN 'WARC-Type,WARC-Target-URI,WARC-Date,WARC-Record-ID,WARC-Warcinfo-ID,WARC-Payload-Digest,WARC-Block-Digest,Content-Type,Content-Length'
  WHEN 'response' THEN 'WARC-Type,WARC-Target-URI,WARC-Date,WARC-Record-ID,WARC-Warcinfo-ID,WARC-Concurrent-To,WARC-IP-Address,WARC-Payload-Digest,WARC-Block-Digest,Content-Type,Content-Length'
  WHEN 'metadata' THEN 'WARC-Type,WARC-Target-URI,WARC-Date,WARC-Record-ID,WARC-Warcinfo-ID,WARC-Concurrent-To,WARC-Block-Digest,Content-Type,Content-Length'
  ELSE 'WARC-Type,WARC-Date,WARC-Record-ID,WARC-Filename,WARC-Block-Digest,Content-Type,Content-Length' END || ',x-b,x-a' AS names FROM ({RECORDS})""")
def canonical_order(spark, sf_dir):
    """Shuffled, differently spelt headers in canonical order."""
    raw = as_raw(captures(spark, sf_dir))
    other = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b" 1").alias("value")) for n in ("x-b", "x-a")])
    mixed = F.transform(F.reverse("headers"), lambda h: F.struct(F.upper(h["name"]).alias("name"), h["value"].alias("value")))
    out = canonicalize.canonicalize(raw.withColumn("headers", F.concat(other, mixed)))
    return out.select(merge.normal_id(grammar.get("WARC-Record-ID")).alias("record_id"), F.array_join(F.transform("headers", lambda h: h["name"]), ",").alias("names"))


@query(f"""SELECT {sql_urn("'r' || page_id::VARCHAR")} AS record_id, CASE page_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'payload' END AS wrong,
  CASE page_id % 3 WHEN 0 THEN 'Declared block digest `md5:00000000000000000000000000000000`, computed `md5:' || md5({RESPONSE}) || '`.'
    WHEN 1 THEN 'Declared payload digest `md5:00000000000000000000000000000000`, computed `md5:' || md5(html) || '`.' END AS message FROM pages
UNION ALL SELECT record_id, NULL, NULL FROM ({RECORDS}) WHERE record_type <> 'response'""")
def digest_check(spark, sf_dir):
    """Declared digests against blocks and payloads."""
    raw = as_raw(captures(spark, sf_dir))
    zero = F.lit(" md5:" + "0" * 32).cast("binary")
    page = F.floor((F.col("record_index") - 1) / 3) + F.substring("file", 6, 6).cast("long") * PER_FILE
    bad = F.when(~is_type("response"), "").when(page % 3 == 0, "warc-block-digest").when(page % 3 == 1, "warc-payload-digest").otherwise("")
    raw = raw.withColumn("headers", F.transform("headers", lambda h: F.struct(h["name"].alias("name"), F.when(F.lower(h["name"]) == bad, zero).otherwise(h["value"]).alias("value"))))
    c = digests.check_digests(records(raw))
    wrong = F.when(F.col("block_digest_error").isNotNull(), "block").when(F.col("payload_digest_error").isNotNull(), "payload")
    return c.select("record_id", wrong.alias("wrong"), F.coalesce(F.col("block_digest_error")["message"], F.col("payload_digest_error")["message"]).alias("message"))


@query("SELECT page_id, sha256(html) AS entity, NULL::VARCHAR AS error FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, NULL, 'No last chunk ends the chunked message.' FROM pages WHERE page_id % 2 = 1")
def entity_body_chunked(spark, sf_dir):
    """Chunked messages, half of them cut off."""
    p = table(spark, sf_dir, "pages")
    b = F.col("html").cast("binary")
    half = F.floor(F.length(b) / 2).cast("int")
    chunk = lambda part: F.concat(F.concat(F.hex(F.length(part)), F.lit(";x=1\r\n")).cast("binary"), part, F.lit(b"\r\n"))
    end = F.when(F.col("page_id") % 2 == 0, F.lit(b"0\r\nTrailer: 1\r\n\r\n")).otherwise(F.lit(b""))
    message = F.concat(F.lit(b"HTTP/1.1 200 OK\r\nTransfer-Encoding:\r\n chunked\r\n\r\n"), chunk(F.substring(b, F.lit(1), half)), chunk(F.substring(b, half + 1, F.length(b))), end)
    out = http.with_entity_body(p.select("page_id", message.alias("body")))
    return out.select("page_id", F.sha2(F.col("entity")["body"], 256).alias("entity"), F.col("entity")["error"].alias("error"))


@query(f"""SELECT page_id, 404::INTEGER AS status, 'b ' || page_id::VARCHAR AS x_a, NULL::VARCHAR AS none,
  sha256('HTTP/1.1 404 Not Found' || {NL} || 'X-A: b' || {NL} || 'Content-Length: ' || strlen(html)::VARCHAR || {NL} || {NL} || html) AS rebuilt FROM pages""")
def http_messages(spark, sf_dir):
    """Status and fields of messages, and rebuilt ones."""
    p = table(spark, sf_dir, "pages")
    body = F.concat(F.lit("HTTP/1.0 404 Gone\r\nA: 1\r\nx-a:  b\r\n "), F.col("page_id").cast("string"), F.lit("\r\nX-A: c\r\n\r\n"), F.col("html")).cast("binary")
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("value")) for n, t in (("X-A", "b"), ("Transfer-Encoding", "chunked"), ("Content-Length", "1"))])
    return p.select("page_id", http.status(body).alias("status"), http.header(body, "X-A").alias("x_a"), http.header(body, "X-B").alias("none"),
                    F.sha2(http.response_block(F.lit(404), fields, F.col("html").cast("binary")), 256).alias("rebuilt"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND json_valid(props) THEN 'application/json' WHEN event_id % 3 = 2 THEN 'image/png' WHEN props IS NOT NULL AND props <> '' THEN 'text/plain' END AS kind FROM events""")
def payload_types(spark, sf_dir):
    """Types by declaration and content."""
    e = table(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_id") % 3 == 2, F.unhex(F.lit("89504E470D0A1A0A0000"))).otherwise(F.col("props").cast("binary")))
    declared = F.when(F.col("event_id") % 3 == 0, "application/ld+json; charset=utf-8").otherwise("text/html")
    return e.select("event_id", http.payload_type(F.col("p"), declared, http.strict_json(F.col("p"))).alias("kind"))


@query("""SELECT page_id, 'a b' AS folded, 2::INTEGER AS n_via, 'v:' || page_id::VARCHAR AS last_via, (page_id % 97)::BIGINT AS ms,
  'hopsFromSeed: LE' || chr(13) || chr(10) || 'via: new' || chr(13) || chr(10) || 'fetchTimeMs: ' || (page_id % 97)::VARCHAR || chr(13) || chr(10) || 'n: a b' || chr(13) || chr(10) AS rewritten,
  CASE WHEN page_id % 5 = 0 THEN 'No field begins at byte 6 of the block.' END AS error FROM pages""")
def fields_blocks(spark, sf_dir):
    """warc-fields blocks parsed, read into columns and changed."""
    p = table(spark, sf_dir, "pages")
    block = F.concat(F.lit("hopsFromSeed : LE\nvia: v\r\nfetchTimeMs: "), (F.col("page_id") % 97).cast("string"), F.lit("\r\nVIA: v:"), F.col("page_id").cast("string"), F.lit("\r\nn: a\r\n\tb\r\n\r\n")).cast("binary")
    broken = F.when(F.col("page_id") % 5 == 0, F.lit(b"a: b\r\n: c\r\n")).otherwise(block)
    d = p.select("page_id", wf.parse(block).alias("f"), wf.parse(broken).alias("g")).withColumn("body_fields", F.col("f")["fields"])
    d = wf.metadata_columns(d)
    return d.select("page_id", wf.get(F.col("body_fields"), "N").alias("folded"), F.size(wf.get_all(F.col("body_fields"), "via")).alias("n_via"),
                    F.element_at(wf.get_all(F.col("body_fields"), "via"), -1).alias("last_via"), F.col("fetch_time_ms").cast("long").alias("ms"),
                    wf.render(wf.put(F.col("body_fields"), "via", F.lit("new"))).cast("string").alias("rewritten"), F.col("g")["error"].alias("error"))


@query(f"""WITH d AS (SELECT doc_id, text, first_value(doc_id) OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS origin FROM documents)
SELECT {sql_urn("'d' || doc_id::VARCHAR")} AS record_id, CASE WHEN doc_id = origin THEN 'resource' ELSE 'revisit' END AS record_type,
  CASE WHEN doc_id <> origin THEN {sql_urn("'d' || origin::VARCHAR")} END AS refers_to, CASE WHEN doc_id = origin THEN strlen(coalesce(text, '')) ELSE 0 END::BIGINT AS size FROM d""")
def revisit_dedup(spark, sf_dir):
    """Documents as resources; equal payloads become revisits of the first, found by digest and written as records."""
    d = table(spark, sf_dir, "documents").withColumn("b", F.coalesce("text", F.lit("")).cast("binary")).withColumn("digest", digests.sha256_digest(F.col("b")))
    first = synth.settled(d.groupBy("digest").agg(F.min("doc_id").alias("origin")))
    # blocks are only joined by id; what meets by digest is narrow, and a digest of many copies is split as a skewed join
    fresh_rows = d.join(first.select(F.col("origin").alias("doc_id")), "doc_id", "left_semi")
    again_rows = d.select("doc_id", "digest").join(first, "digest").where("doc_id <> origin")
    uri = lambda c: F.concat(F.lit("http://example.org/d/"), F.col(c).cast("string"))
    fresh = build(fresh_rows, "resource", record_id=urn(key("d", "doc_id")), date=day("doc_id"), target_uri=uri("doc_id"), body=F.col("b"))
    again = build(again_rows, "revisit", record_id=urn(key("d", "doc_id")), date=day("doc_id"), target_uri=uri("doc_id"),
                  profile=F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), payload_digest=F.col("digest"), refers_to=urn(key("d", "origin")))
    raw = loose(render(fresh.unionByName(again, allowMissingColumns=True)))
    return records(raw).select("record_id", "record_type", "refers_to", F.length("body").cast("long").alias("size"))


@query(f"""SELECT CASE seq WHEN 0 THEN {sql_urn("'q' || k")} WHEN 1 THEN {sql_urn("'r' || k")} ELSE {sql_urn("'m' || k")} END AS record_id, seq::INTEGER AS seq,
  ['request', 'response', 'metadata'][seq + 1] AS record_type, CASE seq WHEN 1 THEN {sql_urn("'q' || k")} WHEN 2 THEN {sql_urn("'r' || k")} END AS concurrent_to
FROM (SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS k FROM conversations), (SELECT unnest([0, 1, 2]) AS seq)""")
def capture_exchange(spark, sf_dir):
    """Three records for each turn of a conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("k", F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    ids = tuple(urn(F.concat(F.lit(x), F.col("k"))) for x in "qrm")
    e = exchange(c, request=F.lit(b"GET / HTTP/1.1\r\n\r\n"), response=F.col("text").cast("binary"), target_uri=F.lit("http://example.org/"), date=day("turn"), ids=ids, fetch_time_ms=F.lit(5))
    return e.select("record_id", "seq", "record_type", "concurrent_to")


@query("""WITH p AS (SELECT page_id, page_id % 16 AS k, page_id // 50 AS f, page_id // 50 % 2 = 1 AS bare FROM pages),
n AS (SELECT *, (k <> 11)::INTEGER AS q, (k <> 9)::INTEGER AS r, (k NOT IN (8, 9))::INTEGER AS m FROM p)
SELECT violation, n FROM (
  SELECT 'MissingWarcinfoId' AS violation, count(*) FILTER (k = 0) AS n FROM p
  UNION ALL SELECT 'WrongWarcinfoId', (coalesce(sum(q + m + CASE WHEN k IN (0, 13) THEN 0 ELSE r END) FILTER (bare), 0) + count(*) FILTER (k = 1 AND NOT bare))::BIGINT FROM n
  UNION ALL SELECT 'MissingPayloadDigest', count(*) FILTER (k = 2) FROM p
  UNION ALL SELECT 'MissingBlockDigest', count(*) FILTER (k = 3) FROM p
  UNION ALL SELECT 'WrongConcurrentTo', count(*) FILTER (k = 4) FROM p
  UNION ALL SELECT 'WrongContentType', count(*) FILTER (k = 5) FROM p
  UNION ALL SELECT 'WrongTargetUri', count(*) FILTER (k = 6) FROM p
  UNION ALL SELECT 'NonCanonicalHeaderOrder', count(*) FILTER (k = 7) FROM p
  UNION ALL SELECT 'ResponseWithoutMetadata', count(*) FILTER (k = 8) FROM p
  UNION ALL SELECT 'RequestWithoutResponse', count(*) FILTER (k = 9) FROM p
  UNION ALL SELECT 'MissingFetchTime', count(*) FILTER (k IN (10, 12)) FROM p
  UNION ALL SELECT 'ResponseWithoutRequest', count(*) FILTER (k = 11) FROM p
  UNION ALL SELECT 'MissingContentType', count(*) FILTER (k = 12) FROM p
  UNION ALL SELECT 'FirstRecordNotWarcinfo', count(*) FILTER (bare AND page_id % 50 = 0 AND k <> 11) FROM p
) WHERE n > 0""")
def lint_summary(spark, sf_dir):
    """All findings by rule over whole files, each page's capture with the fault of its class, and every other file without its warcinfo record."""
    return lint.summary(lint.lint(records(as_raw(planted_faults(captures(spark, sf_dir))))))


def planted_faults(c):
    """Captures with a fault by page_id % 16: a header or block changed, records taken out, an unreadable one, and two classes without any."""
    k, kind, bare = F.col("page_id") % 16, F.col("record_type"), F.floor(F.col("page_id") / PER_FILE) % 2 == 1
    gone = ((k == 8) & (kind == "metadata") | (k == 9) & kind.isin("response", "metadata") | (k == 11) & (kind == "request")) & (kind != "warcinfo") | bare & (kind == "warcinfo")
    headers = F.col("headers")
    changes = [
        (0, "response", _drop(headers, "WARC-Warcinfo-ID")), (1, "response", _swap(headers, "WARC-Warcinfo-ID", "<urn:x:y>")), (2, "response", _drop(headers, "WARC-Payload-Digest")),
        (3, "metadata", _drop(headers, "WARC-Block-Digest")), (4, "metadata", _drop(headers, "WARC-Concurrent-To")), (5, "request", _swap(headers, "Content-Type", "text/plain")),
        (6, "response", _swap(headers, "WARC-Target-URI", "http://other.example/")), (7, "request", F.reverse(headers)), (10, "metadata", _swap(headers, "Content-Length", "8")),
        (12, "metadata", _drop(headers, "Content-Type")), (13, "response", _swap(headers, "WARC-Date", "yesterday")),
    ]
    changed = headers
    for i, of, made in changes:
        changed = F.when((k == i) & (kind == of), made).otherwise(changed)
    other = (k == 10) & (kind == "metadata")
    return c.where(~gone).withColumns({
        "headers": changed, "body": F.when(other, F.lit(b"via: x\r\n")).otherwise(F.col("body")), "content_length": F.when(other, 8).otherwise(F.col("content_length")).cast("decimal(20,0)"),
        "place": F.col("place") - bare.cast("int")})


def _drop(headers, name):
    return F.filter(headers, lambda h: F.lower(h["name"]) != name.lower())


def _swap(headers, name, text):
    return F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.when(
        F.lower(h["name"]) == name.lower(), F.lit(" " + text).cast("binary")).otherwise(h["value"]).alias("value")))


@query(f"""WITH f AS (SELECT page_id // 50 AS f, min(page_id) AS d FROM pages GROUP BY 1)
SELECT 'records' AS what, ((SELECT count(*) FROM pages) * 3 + 1) AS n UNION ALL SELECT 'kept ' || (SELECT {sql_urn("'i' || f::VARCHAR")} FROM f ORDER BY d, f LIMIT 1), 1
UNION ALL SELECT 'references to ' || (SELECT {sql_urn("'i' || f::VARCHAR")} FROM f ORDER BY d, f LIMIT 1), (SELECT count(*) FROM pages) * 3""")
def merge_archives(spark, sf_dir):
    """Equal warcinfo records become the earliest one, and references follow."""
    raw = as_raw(captures(spark, sf_dir))
    raw = raw.withColumn("file_seq", F.substring("file", 6, 6).cast("int"))
    m = merge.merge(raw)
    kind = F.lower(v.trim_space(v.latin(grammar.get("WARC-Type"))))
    rows = m.select(kind.alias("kind"), merge.normal_id(grammar.get("WARC-Record-ID")).alias("id"), merge.normal_id(grammar.get("WARC-Warcinfo-ID")).alias("ref"))
    what = F.array(F.lit("records"), F.when(F.col("kind") == "warcinfo", F.concat(F.lit("kept "), F.col("id"))), F.when(F.col("ref").isNotNull(), F.concat(F.lit("references to "), F.col("ref"))))
    return rows.select(F.explode(F.filter(what, lambda w: w.isNotNull())).alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH b AS (SELECT page_id // 50 AS f, replace(replace({INFO}, 'websilo/1.0', 'other/1.0'), 'ada@example.org', 'new@example.org') || 'isPartOf: set-7' || {NL} AS body FROM pages GROUP BY 1)
SELECT {sql_urn("'i' || f::VARCHAR")} AS record_id, body, 'sha256:' || sha256(body) AS digest, strlen(body)::VARCHAR AS length, 'new.warc' AS filename FROM b""")
def rewrite_warcinfo(spark, sf_dir):
    """Fields of warcinfo blocks set, lengths and digests following."""
    out = rewrite.rewrite_warcinfo(records(grammar.where_type(as_raw(captures(spark, sf_dir)), "warcinfo")), "new.warc", ("other", None), (None, "new@example.org"), "set-7")
    text = lambda n: F.trim(grammar.get(n).cast("string"))
    return out.select("record_id", F.col("body").cast("string").alias("body"), text("WARC-Block-Digest").alias("digest"), text("Content-Length").alias("length"), text("WARC-Filename").alias("filename"))


@query(f"""SELECT record_type AS type, {sql_day('page_id')} AS date, substr(record_id, 5) AS record_id, coalesce(target_uri, '') AS target_uri FROM ({RECORDS})""")
def export_csv(spark, sf_dir):
    """Rows of the CSV export."""
    return export.csv_rows(headers_of(as_raw(captures(spark, sf_dir)))).select("type", "date", "record_id", "target_uri")


@query(f"""SELECT {sql_urn("'e' || event_id::VARCHAR")} AS record_id, CASE WHEN json_valid(props) THEN props END AS line FROM events WHERE event_id % 2 = 0""")
def export_json(spark, sf_dir):
    """Lines of the JSON export: records that declare a JSON payload."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "props"), "event_id")
    rows = build(e, "resource", record_id=urn(key("e", "event_id")), date=day("event_id"), target_uri=F.lit("http://example.org/e"),
                 identified_payload_type=F.when(F.col("event_id") % 2 == 0, "application/ld+json").otherwise("text/plain"), body=F.concat(F.col("props"), F.lit("\r\n")).cast("binary"))
    raw = loose(render(rows))
    return export.json_lines(headers_of(raw)).select("record_id", "line")


@query("SELECT label, count(*) AS n FROM (SELECT unnest(['concurrent-to', 'concurrent-to', 'warcinfo-id', 'warcinfo-id', 'warcinfo-id']) AS label FROM pages) GROUP BY label")
def graph_edges(spark, sf_dir):
    """References between records of a file, by label."""
    return graph.edges(as_raw(captures(spark, sf_dir))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH u AS (SELECT page_id // 50 AS f, substr(record_id, 10) AS uuid, record_id FROM ({RECORDS})),
p AS (SELECT u.*, n FROM u, (SELECT unnest(range(8, 37)) AS n)),
c AS (SELECT f, n, substr(uuid, 1, n::INTEGER) AS pre, count(DISTINCT uuid) AS k FROM p GROUP BY ALL)
SELECT p.record_id, substr(p.uuid, 1, min(p.n)::INTEGER) AS label FROM p JOIN c ON p.f = c.f AND p.n = c.n AND substr(p.uuid, 1, p.n::INTEGER) = c.pre AND c.k = 1 GROUP BY p.record_id, p.uuid""")
def graph_labels(spark, sf_dir):
    """Shortest distinguishing labels."""
    return graph.labels(graph.nodes(as_raw(captures(spark, sf_dir)))).select("record_id", "label")


@query(f"""SELECT {sql_urn("'m' || page_id::VARCHAR")} AS record_id, {sql_urn("'r' || page_id::VARCHAR")} AS target FROM pages WHERE page_id % 4 = 0""")
def dangling_references(spark, sf_dir):
    """References to records that a file lacks."""
    raw = as_raw(captures(spark, sf_dir).where(~((F.col("page_id") % 4 == 0) & (F.col("record_type") == "response"))))
    d = graph.dangling(raw)
    ids = graph.nodes(raw).select("file", "record_index", "record_id")
    return d.join(ids, ["file", "record_index"]).select("record_id", "target")


@query("""WITH c AS (SELECT page_id // 50 AS f, 3 * count(*) + 1 AS n, count(*) FILTER ((page_id % 50) % 9 IN (3, 5)) AS g, count(*) FILTER ((page_id % 50) % 9 < 8) AS r FROM pages GROUP BY 1)
SELECT f::BIGINT AS file_no, 'raw' AS level, n AS records, 0::BIGINT AS errors, 'passed' AS status FROM c
UNION ALL SELECT f, 'untyped', n - g, g, CASE WHEN g = 0 THEN 'passed' ELSE 'failed' END FROM c
UNION ALL SELECT f, 'record', n - r, r, CASE WHEN r = 0 THEN 'passed' ELSE 'failed' END FROM c""")
def validate_levels(spark, sf_dir):
    """Tallies of faulty files at each level."""
    out = validate.validate_all(faulty(spark, sf_dir))
    return out.select(F.substring("file", 6, 6).cast("long").alias("file_no"), "level", "records", "errors", "status")


@query(f"""SELECT {sql_urn("'c' || doc_id::VARCHAR || '-1'")} AS record_id, greatest(1, ceil(strlen(coalesce(text, '')) / 1000.0))::BIGINT AS segments, sha256(coalesce(text, '')) AS block FROM documents""")
def segment_reassembly(spark, sf_dir):
    """Documents cut into segments of 1,000 bytes, and put together again."""
    d = table(spark, sf_dir, "documents").withColumn("b", F.coalesce("text", F.lit("")).cast("binary"))
    n = F.greatest(F.lit(1), F.ceil(F.length("b") / 1000)).cast("int")
    d = d.select("doc_id", "b", F.explode(F.sequence(F.lit(1), n)).alias("n"))
    part = F.substring("b", (F.col("n") - 1) * 1000 + 1, F.lit(1000))
    ident = lambda i: urn(F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string")))
    common = {"date": day("doc_id"), "target_uri": F.concat(F.lit("http://example.org/"), F.col("doc_id").cast("string")), "body": part, "segment_number": F.col("n").cast("string")}
    first = build(d.where("n = 1"), "resource", record_id=ident(F.lit(1)), **common)
    rest = build(d.where("n > 1"), "continuation", record_id=ident(F.col("n")), segment_origin_id=ident(F.lit(1)), **common)
    raw = loose(render(first.unionByName(rest, allowMissingColumns=True)))
    return semantic.segment_bodies(headers_of(raw)).select("record_id", "segments", F.sha2("body", 256).alias("block"))


@query("""SELECT page_id, length('http://example.org/' || repeat('a%20b/', 900) || page_id::VARCHAR)::INTEGER AS uri_length, 5000::INTEGER AS parameter_length,
  CASE WHEN page_id % 2 = 0 THEN 'Malformed field line: X-Long' END AS why, NULL::VARCHAR AS bad_uri FROM pages""")
def long_values(spark, sf_dir):
    """URIs, parameters and header values of thousands of characters."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    uri = F.concat(F.lit("http://example.org/"), F.repeat(F.lit("a%20b/"), F.lit(900)), i)
    media = v.media_type(F.concat(F.lit('text/plain; a=b; x="'), F.repeat(F.lit('\\"'), F.lit(5000)), F.lit('"; c=d')))
    value = F.concat(F.lit(" "), F.repeat(F.lit("x\r\n y"), F.lit(1000)), F.when(F.col("page_id") % 2 == 0, F.lit("\rz")).otherwise(F.lit("z"))).cast("binary")
    headers = F.array(F.struct(F.lit("X-Long").alias("name"), value.alias("value")), F.struct(F.lit("Content-Length").alias("name"), F.lit(b" 0").alias("value")))
    p = p.select("page_id", uri.alias("u"), media.alias("m"), headers.alias("headers"), F.lit(b"").alias("body"))
    return p.select("page_id", F.length(v.bare_uri(F.col("u"))).alias("uri_length"), F.length(v.parameter(F.col("m"), "X")).alias("parameter_length"),
                    invalid_reason().alias("why"), v.bare_uri(F.concat(F.col("u"), F.lit("%2"))).alias("bad_uri"))


@query(f"""SELECT record_type, count(*) AS n, (SELECT count(DISTINCT page_id // 50) FROM pages) AS files FROM ({RECORDS}) GROUP BY record_type""")
def append_archives(spark, sf_dir):
    """Archives written in two jobs, the second behind the first."""
    rows, path = synth.settled(captures(spark, sf_dir)), new_folder(spark, "appended")
    for odd in (0, 1):
        part = rows.where(F.col("file_no") % 2 == odd).repartition("file_no").sortWithinPartitions("file_no", "place")
        write_warc(part, path, level=1, append=bool(odd))
    raw = read_warc(spark, path, bodies=False)
    infos = raw.where(F.lower(v.trim_space(v.latin(grammar.get("WARC-Type")))) == "warcinfo").agg(F.count(F.lit(1)).alias("files"))
    kinds = raw.groupBy(F.lower(v.trim_space(v.latin(grammar.get("WARC-Type")))).alias("record_type")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(F.broadcast(infos), F.lit(True)).select("record_type", "n", "files")


@query(f"""SELECT record_type, count(*) AS n, 0::BIGINT AS errors, true AS contiguous, sum(strlen(body))::BIGINT AS bytes FROM ({RECORDS}) GROUP BY record_type""")
def written_rows(spark, sf_dir):
    """One gzip stream a file, and the rows that writing returns, by the records' places."""
    rows, path = captures(spark, sf_dir).repartition("file_no").sortWithinPartitions("file_no", "place"), new_folder(spark, "streams")
    written = write_warc(rows, path, "gzip", level=1, stream=True)
    files = written.groupBy("file").agg(F.count("error").alias("errors"), F.max("record_index").alias("last"), F.count(F.lit(1)).alias("n"))
    totals = files.agg(F.sum("errors").alias("errors"), F.min(F.col("last") + 1 == F.col("n")).alias("contiguous"))
    raw = read_warc(spark, path)
    kinds = raw.groupBy(F.lower(v.trim_space(v.latin(grammar.get("WARC-Type")))).alias("record_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body").cast("long")).alias("bytes"))
    return kinds.join(F.broadcast(totals), F.lit(True)).select("record_type", "n", "errors", "contiguous", "bytes")


@query(f"""SELECT record_id, sha256(body) AS block FROM ({RECORDS})""")
def recompressed(spark, sf_dir):
    """A plain archive copied with a gzip member for each record."""
    path = new_folder(spark, "copied")
    rewrite.compress(captured(spark, sf_dir, compression="none"), path, level=1).collect()
    return read_warc(spark, path).select(merge.normal_id(grammar.get("WARC-Record-ID")).alias("record_id"), F.sha2("body", 256).alias("block"))


@query("""WITH r AS (SELECT page_id, t, CASE WHEN t = 2 THEN (page_id % 50) % 9 ELSE 8 END AS k FROM pages, (SELECT unnest([1, 2, 3]) AS t))
SELECT level, code, count(*) AS n FROM (SELECT 'untyped' AS level, CASE WHEN k IN (3, 5) THEN 'MalformedField' END AS code, k, page_id, t FROM r
  UNION ALL SELECT 'record', CASE k WHEN 0 THEN 'MissingField' WHEN 1 THEN 'ForbiddenField' WHEN 2 THEN 'RepeatedField' WHEN 3 THEN 'MalformedField' WHEN 4 THEN 'UnknownRecordType'
    WHEN 5 THEN 'MalformedField' WHEN 6 THEN 'MissingField' WHEN 7 THEN 'MalformedField' END, k, page_id, t FROM r)
WHERE code IS NOT NULL OR (level = 'untyped' AND (page_id % 50) * 3 + t > 75) OR (level = 'record' AND page_id % 2 = 0 ) GROUP BY ALL""")
def filter_keeps_faults(spark, sf_dir):
    """Records by a predicate at each level: faults stay, whatever it says."""
    raw = synth.settled(faulty(spark, sf_dir))
    page = F.floor((F.col("record_index") - 1) / 3) + F.substring("file", 6, 6).cast("long") * PER_FILE
    untyped = semantic.where_untyped(raw, F.col("record_index") > 75).select(F.lit("untyped").alias("level"), F.col("error")["code"].alias("code"))
    whole = semantic.where_records(grammar.to_untyped(raw), page % 2 == 0).select(F.lit("record").alias("level"), F.col("error")["code"].alias("code"))
    return untyped.unionByName(whole).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_id, CASE k WHEN 0 THEN strftime(s, '%Y') WHEN 1 THEN strftime(s, '%Y-%m') WHEN 2 THEN strftime(s, '%Y-%m-%d') WHEN 3 THEN strftime(s, '%Y-%m-%dT%H:%MZ')
    WHEN 4 THEN strftime(s, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(s, '%Y-%m-%dT%H:%M:%S.') || rpad(substr(lpad((event_id % 1000)::VARCHAR, 3, '0'), 1, least(d, 3)), d, '0') || 'Z' END AS made,
  strftime(s, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad((event_id % 1000)::VARCHAR, 3, '0'), '0') END || 'Z' AS shortest
FROM (SELECT event_id, event_id % 6 AS k, greatest(1, least(9, event_id % 11))::INTEGER AS d, {_STAMP} AS s FROM events)""")
def dates_from_timestamps(spark, sf_dir):
    """Dates of every precision from timestamps, and in the shortest form."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 6
    ts = F.timestamp_micros((F.lit(1704067200) + F.col("event_id")) * 1_000_000 + F.col("event_id") % 1000 * 1000)
    precision = F.element_at(F.array(*[F.lit(x) for x in ("year", "month", "day", "minute", "second", "fraction")]), (k + 1).cast("int"))
    d = e.select("event_id", v.made_date(ts, precision, digits=(F.col("event_id") % 11).cast("int")).alias("a"), v.date_of(ts).alias("b"))
    return d.select("event_id", F.col("a")["text"].alias("made"), F.col("b")["text"].alias("shortest"))


@query("""SELECT event_id, CASE k WHEN 0 THEN 'a"b\\c' WHEN 1 THEN '' END AS content, CASE k WHEN 2 THEN 'no opening quote' WHEN 3 THEN 'no closing quote' WHEN 4 THEN 'text behind the closing quote'
  WHEN 5 THEN 'control character' WHEN 6 THEN 'no character behind a backslash' END AS error, CASE k WHEN 2 THEN 0 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE -1 END::BIGINT AS "at",
  k < 2 AS is_text, k = 2 AS is_token FROM (SELECT event_id, event_id % 7 AS k FROM events)""")
def quoted_strings(spark, sf_dir):
    """Quoted strings, and what is wrong with others."""
    texts = ['"a\\"b\\\\c"', '""', "abc", '"abc', '"abc"d', '"a\x01"', '"a\\']
    t = F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    e = e.select("event_id", v.unquoted(F.col("t")).alias("u"), (v.text_value(F.col("t"))["quoted"] & F.col("t").isNotNull()).alias("x"), v.is_token(F.col("t")).alias("is_token"))
    return e.select("event_id", F.col("u")["content"].alias("content"), F.col("u")["error"].alias("error"), F.coalesce(F.col("u")["at"], F.lit(-1)).alias("at"), F.coalesce("x", F.lit(False)).alias("is_text"), "is_token")


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN CASE WHEN html LIKE '<!doctype html%' OR lower(html) LIKE '<html%' OR lower(html) LIKE '<!doctype html%' THEN 'text/html' ELSE 'text/plain' END
  WHEN 2 THEN 'image/png' END AS kind, CASE page_id % 4 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html; charset=x' WHEN 2 THEN NULL ELSE 'a/b' END AS declared FROM pages""")
def http_message_types(spark, sf_dir):
    """Types of the payloads of whole messages."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    message = (F.when(k == 0, F.lit(b"HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nTransfer-Encoding: chunked\r\n\r\n2\r\n{}\r\n0\r\n\r\n"))
               .when(k == 1, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=x\r\ncontent-type: a/b\r\n\r\n"), F.ltrim("html")).cast("binary"))
               .when(k == 2, F.concat(F.lit(b"HTTP/1.1 200 OK\r\n\r\n"), F.unhex(F.lit("89504E470D0A1A0A00"))))
               .otherwise(F.lit(b"HTTP/1.1 200 OK\r\nContent-Type: a/b\r\nTransfer-Encoding: gzip\r\n\r\nx")))
    out = http.with_message_type(p.select("page_id", message.alias("body")))
    return out.select("page_id", F.col("payload_type").alias("kind"), http.declared_type(F.col("body")).alias("declared"))


@query("""SELECT event_id, ['none', 'length', 'chunked', 'close', NULL, NULL, 'none'][k + 1] AS kind, CASE WHEN k = 1 THEN event_id ELSE -1 END AS length,
  CASE k WHEN 4 THEN 'lengths that differ' WHEN 5 THEN 'a length that is no number' END AS error FROM (SELECT event_id, event_id % 7 AS k FROM events)""")
def http_framing(spark, sf_dir):
    """How messages' bodies end."""
    k, i = F.col("event_id") % 7, F.col("event_id").cast("string")
    heads = [F.lit("HTTP/1.1 304 x\r\nContent-Length: 5"), F.concat(F.lit("HTTP/1.1 200 OK\r\ncontent-length: "), i), F.lit("HTTP/1.1 200 OK\r\nContent-Length: 5\r\nTransfer-Encoding: gzip, Chunked"),
             F.lit("HTTP/1.1 200 OK\r\nA: b"), F.lit("HTTP/1.1 200 OK\r\nContent-Length: 5\r\nContent-Length: 6"), F.lit("HTTP/1.1 200 OK\r\nContent-Length: x"), F.lit("GET / HTTP/1.1\r\nA: b")]
    body = F.concat(F.element_at(F.array(*heads), (k + 1).cast("int")), F.lit("\r\n\r\nbody")).cast("binary")
    e = table(spark, sf_dir, "events").select("event_id", http.body_framing(body, k == 6).alias("f"))
    return e.select("event_id", F.col("f")["kind"].alias("kind"), F.coalesce(F.col("f")["length"], F.lit(-1)).alias("length"), F.col("f")["error"].alias("error"))


@query(f"""SELECT {sql_urn("'v' || page_id::VARCHAR")} AS record_id, {sql_urn("'r' || page_id::VARCHAR")} AS refers_to, url AS refers_to_target_uri, {sql_day('page_id')} AS refers_to_date,
  'sha256:' || sha256(html) AS payload_digest, strlen({HEAD})::BIGINT AS size, 'length' AS truncated FROM pages""")
def revisit_exchange(spark, sf_dir):
    """Captures seen again: revisits of the originals of an archive, which keep the head alone."""
    originals = revisit_original(headers_of(as_raw(captures(spark, sf_dir))), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    kept = F.lit(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")
    pages = table(spark, sf_dir, "pages").withColumn("refers_to", urn(key("r", "page_id"))).join(originals, "refers_to")
    names = ("profile", "refers_to", "refers_to_target_uri", "refers_to_date", "payload_digest")
    e = exchange(pages, request=F.lit(b"GET / HTTP/1.1\r\n\r\n"), response=kept, target_uri=F.col("url"), date=day("page_id"),
                 ids=(urn(key("p", "page_id")), urn(key("v", "page_id")), urn(key("n", "page_id"))), revisit={n: F.col(n) for n in names})
    r = records(loose(render(e))).where(F.col("record_type") == "revisit")
    digest = F.concat(F.col("payload_digest")["label"], F.lit(":"), F.col("payload_digest")["value"])
    return r.select("record_id", "refers_to", "refers_to_target_uri", F.col("refers_to_date")["text"].alias("refers_to_date"), digest.alias("payload_digest"),
                    F.length("body").cast("long").alias("size"), "truncated")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Ada' ELSE 'Ada <a' || page_id::VARCHAR || '@example.org>' END AS operator, 'crawler/1.' || page_id::VARCHAR AS software,
  'via: http://example.org/' || chr(13) || chr(10) || 'hopsFromSeed: L' || chr(13) || chr(10) || 'fetchTimeMs: ' || (page_id * 1500)::VARCHAR || chr(13) || chr(10) AS metadata,
  CASE page_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'isPartOf' END AS term, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_element FROM pages""")
def body_setters(spark, sf_dir):
    """Blocks of warcinfo and metadata records from their parts, and DCMI names."""
    p, i = table(spark, sf_dir, "pages"), F.col("page_id").cast("string")
    info = wf.warcinfo_body(operator=(F.lit("Ada"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("a"), i, F.lit("@example.org")))), software=(F.lit("crawler"), F.concat(F.lit("1."), i)))
    meta = wf.metadata_body(via=F.lit("http://example.org/"), hops_from_seed=F.lit("L"), fetch_time=F.col("page_id") * 1.5 + F.lit(0.0004))
    term = wf.dcmi_term(F.element_at(F.array(F.lit("TITLE"), F.lit("ispartof"), F.lit("x")), (F.col("page_id") % 3 + 1).cast("int")))
    d = p.select("page_id", info.alias("i"), meta.alias("m"), term.alias("t"))
    return d.select("page_id", wf.get(F.col("i"), "operator").alias("operator"), wf.get(F.col("i"), "software").alias("software"),
                    wf.render(F.col("m")).cast("string").alias("metadata"), F.col("t")["name"].alias("term"), F.col("t")["is_element"].alias("is_element"))


@query("""SELECT page_id, 'a,b,b2' AS pushed, CASE WHEN page_id % 4 <> 0 THEN page_id ELSE -1 END AS n, CASE WHEN page_id % 4 <> 0 THEN 'true,false' END AS flags,
  CASE WHEN page_id % 4 = 0 THEN 'The value of `n` is of another type.' END AS error, CASE WHEN page_id % 4 <> 0 THEN 'n=' || page_id::VARCHAR || ',flag=true,flag=false' ELSE '' END AS back FROM pages""")
def typed_fields(spark, sf_dir):
    """Fields pushed, read into typed columns, and written again."""
    from pyspark.sql import types as T

    p = table(spark, sf_dir, "pages")
    none = F.array().cast("array<struct<name: string, value: string>>")
    pushed = wf.push(wf.push(wf.push(wf.push(none, "x", F.lit("a")), "y", F.lit("b")), "Y", F.lit("b2")), "z", F.lit(None).cast("string"))
    fields = field_list(N=F.when(F.col("page_id") % 4 == 0, "x").otherwise(F.col("page_id").cast("string")), flag=F.lit("true"), FLAG=F.lit("false"))
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("flag", T.ArrayType(T.BooleanType()))])
    d = wf.from_fields(p.select("page_id", pushed.alias("p"), fields.alias("body_fields")), schema)
    d = wf.to_fields(d.withColumn("value", F.col("data")["value"]), "value", schema, "again")
    return d.select("page_id", F.array_join(F.transform("p", lambda f: f["value"]), ",").alias("pushed"), F.coalesce(F.col("value")["n"], F.lit(-1)).alias("n"),
                    F.array_join(F.transform(F.col("value")["flag"], lambda f: f.cast("string")), ",").alias("flags"),
                    F.col("data")["error"].alias("error"), F.array_join(F.transform("again", lambda f: F.concat(f["name"], F.lit("="), f["value"])), ",").alias("back"))


@query(f"""SELECT {sql_urn("'t' || page_id::VARCHAR")} AS record_id, ['length', 'standard', 'paused', 'extension', 'other', 'unknown'][(page_id % 3) * 2 + 1] AS truncated,
  ['length', 'standard', 'paused', 'extension', 'other', 'unknown'][(page_id % 3) * 2 + 2] AS kind, 'p' || page_id::VARCHAR AS claimed, 1::INTEGER AS others, 'sha1:' || upper(sha1(html)) AS digest FROM pages""")
def extension_records(spark, sf_dir):
    """Records of a type, reasons and fields that an extension defines, and SHA-1 digests added."""
    ext = semantic.Extension(record_types=("snapshot",), truncations=("paused",), fields={"snapshot": ("X-Pass",)})
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    reason = F.element_at(F.array(F.lit("length"), F.lit("Paused"), F.lit("Other")), (F.col("page_id") % 3 + 1).cast("int"))
    line = lambda n, t: F.struct(F.lit(n).alias("name"), F.concat(F.lit(" "), t).cast("binary").alias("value"))
    body = F.col("html").cast("binary")
    headers = F.array(line("WARC-Type", F.lit("Snapshot")), line("WARC-Record-ID", F.concat(F.lit("<"), urn(key("t", "page_id")), F.lit(">"))), line("WARC-Date", day("page_id")),
                      line("WARC-Truncated", reason), line("x-pass", F.concat(F.lit("p"), F.col("page_id").cast("string"))), line("X-Else", F.lit("1")), line("Content-Length", F.length(body).cast("string")))
    raw = synth.settled(p.select(F.lit("x").alias("file"), F.col("page_id").alias("record_index"), F.lit("1.1").alias("version"), headers.alias("headers"),
                                 F.length(body).cast("decimal(20,0)").alias("content_length"), body.alias("body"), grammar.no_error().alias("error")))
    r = digests.add_sha1_digests(semantic.to_semantic(grammar.to_untyped(raw), ext))
    left = ext.claim(F.col("unrecognized"), F.col("record_type"))["left"]
    return r.select("record_id", "truncated", v.truncation_kind(F.col("truncated"), ext.truncations).alias("kind"), F.col("ext_x_pass").alias("claimed"),
                    F.size(left).alias("others"), F.concat(F.lit("sha1:"), F.hex(v.decoded(F.col("block_digest")))).alias("digest"))


@query(f"""SELECT {sql_urn("'o' || page_id::VARCHAR")} AS record_id, '<' || url || '>' AS target, {sql_day('page_id')} AS date, CASE WHEN page_id % 2 = 0 THEN 'The `WARC-Refers-To-Date` is unknown to WARC 1.0.' END AS error FROM pages""")
def version_1_0(spark, sf_dir):
    """Records of WARC 1.0: all URIs in brackets, dates in seconds, no later fields."""
    p = table(spark, sf_dir, "pages")
    e = p.select(F.lit("1.0").alias("version"), F.lit("revisit").alias("record_type"), urn(key("o", "page_id")).alias("record_id"), F.col("url").alias("target_uri"),
                 v.show_date(v.date_of(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))), "1.0").alias("date"),
                 F.lit("http://netpreserve.org/warc/1.0/revisit/server-not-modified").alias("profile"), F.when(F.col("page_id") % 2 == 0, day("page_id")).alias("refers_to_date"), F.lit(b"").alias("body"))
    r = render(e)
    text = lambda n: F.trim(grammar.get(n).cast("string"))
    return r.select("record_id", text("WARC-Target-URI").alias("target"), text("WARC-Date").alias("date"), "error")


@query("""WITH f AS (SELECT DISTINCT page_id // 50 AS f FROM pages)
SELECT level, CASE WHEN level = 'raw' THEN n ELSE 0 END AS passed, CASE WHEN level = 'raw' THEN 0 ELSE n END AS failed, 0::BIGINT AS error, 1::BIGINT AS unavailable, false AS success
FROM (SELECT unnest(['raw', 'untyped', 'record']) AS level, (SELECT count(*) FROM f) AS n)
UNION ALL SELECT 'all', (SELECT count(*) FROM f), 2 * (SELECT count(*) FROM f), 0, 3, false""")
def validate_summary(spark, sf_dir):
    """Files by status over the levels, with one that was expected but isn't there."""
    raw = synth.settled(faulty(spark, sf_dir))
    files = raw.select("file").distinct().unionByName(spark.createDataFrame([("part-none.warc",)], "file string"))
    out = validate.summary(validate.expected(synth.settled(validate.validate_all(raw)), files))
    return out.withColumn("level", F.coalesce("level", F.lit("all")))


@query(f"""SELECT section, count(*) AS n, count(DISTINCT line) > 0 AS some, min(ok) AS shaped FROM (
  SELECT 0 AS section, record_id AS line, true AS ok FROM ({RECORDS})
  UNION ALL SELECT 1, record_id, true FROM ({RECORDS}), (SELECT unnest([1, 2]) AS k) WHERE record_type IN ('response', 'metadata')
  UNION ALL SELECT 1, record_id, true FROM ({RECORDS}) WHERE record_type = 'request') GROUP BY section""")
def graph_lines(spark, sf_dir):
    """D2 lines of nodes and references."""
    d = graph.d2_lines(as_raw(captures(spark, sf_dir)))
    shaped = F.when(F.col("section") == 0, F.col("line").rlike(r'^records\.record_[0-9]+: "[^"]+" \{ style\.fill: "#[0-9A-F]{6}" \}$')).otherwise(
        F.col("line").rlike(r'^records\.record_[0-9]+ -> records\.record_[0-9]+: "[a-z-]+"$'))
    return d.groupBy("section").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("line") > 0).alias("some"), F.min(shaped).alias("shaped"))


__all__ = ["ORACLES", "QUERIES", "field_list"]


def page_of(place):
    """The page of a capture's record, by its place in its file of captures."""
    return F.floor((place - 1) / 3) + F.substring("file", 6, 6).cast("long") * PER_FILE


_BLOCK_DIGEST = "'WARC-Block-Digest: sha256:' || sha256(body) || '|'"
_KIND = "CASE WHEN record_type = 'warcinfo' THEN 9 ELSE page_id % 9 END"


@query(f"""WITH r AS (SELECT record_type, record_id, page_id, target_uri, CASE WHEN record_type = 'metadata' THEN body || 'via: ' || target_uri || chr(13) || chr(10) ELSE body END AS body,
  {_KIND} AS k, {sql_urn("'i' || (page_id // 50)::VARCHAR")} AS info, {sql_day("page_id")} AS d, {sql_urn("'q' || page_id::VARCHAR")} AS q, {sql_urn("'r' || page_id::VARCHAR")} AS rr FROM ({RECORDS})),
e AS (SELECT *, CASE WHEN record_type <> 'response' THEN NULL WHEN k = 0 THEN 'ReservedField' WHEN k = 1 THEN 'ForbiddenField' WHEN k = 2 THEN 'UnwritableField'
  WHEN k = 3 THEN 'ValueNotInVersion' WHEN k = 4 THEN 'BlockDigestMismatch' WHEN k = 5 THEN 'MissingField' END AS error FROM r)
SELECT record_id, error, CASE WHEN error IS NOT NULL THEN NULL WHEN record_type = 'warcinfo' THEN
    'WARC-Type: warcinfo|WARC-Date: ' || d || '|WARC-Record-ID: <' || record_id || '>|WARC-Filename: "a \\"part\\" of ' || (page_id // 50)::VARCHAR || '.warc"|'
    || {_BLOCK_DIGEST} || 'Content-Type: application/warc-fields|Content-Length: ' || strlen(body)::VARCHAR || '|X-Seen: once'
  ELSE 'WARC-Type: ' || record_type || '|WARC-Target-URI: ' || target_uri || '|WARC-Date: ' || CASE WHEN record_type = 'request' THEN d[1:16] || 'Z' ELSE d END || '|WARC-Record-ID: <' || record_id || '>|WARC-Warcinfo-ID: <' || info || '>|'
    || CASE record_type WHEN 'response' THEN 'WARC-Concurrent-To: <' || q || '>|WARC-Concurrent-To: <urn:x:second>|WARC-IP-Address: 2001:db8::1|' WHEN 'metadata' THEN 'WARC-Concurrent-To: <' || rr || '>|' ELSE '' END
    || CASE record_type WHEN 'response' THEN 'WARC-Payload-Digest: sha256:' || sha256(html) || '|' WHEN 'request' THEN 'WARC-Payload-Digest: sha256:' || sha256('') || '|' ELSE '' END
    || {_BLOCK_DIGEST} || 'Content-Type: ' || CASE record_type WHEN 'metadata' THEN 'application/warc-fields' ELSE 'application/http; msgtype=' || record_type || CASE WHEN record_type = 'response' THEN '; note="a b"' ELSE '' END END
    || '|Content-Length: ' || strlen(body)::VARCHAR || '|X-Seen: once' END AS header,
  CASE WHEN error IS NULL THEN sha256(body) END AS block FROM e LEFT JOIN (SELECT page_id, html FROM pages) USING (page_id)""")
def render_read(spark, sf_dir):
    """Records that were read, changed, rendered, written, and read again; some changes can't be written."""
    raw = as_raw(captures(spark, sf_dir)).withColumn("headers", F.concat("headers", F.array(F.struct(F.lit("X-Seen").alias("name"), F.lit(b"  once ").alias("value")))))
    r = records(raw).withColumn("k", page_of(F.col("record_index")) % 9)
    answer, extra = F.col("record_type") == "response", F.struct(F.lit("WARC-Date").alias("name"), F.lit("2024").alias("value"))
    odd = lambda k, new, old: F.when(answer & (F.col("k") == k), new).otherwise(F.col(old))
    note = F.struct(F.lit("note").alias("name"), F.lit("a b").alias("value"), F.lit(None).cast("boolean").alias("quoted"), F.lit(None).cast("string").alias("separator"))
    name = F.regexp_replace(F.col("filename")["content"], "part-(.*)", 'a "part" of $1')
    date = lambda p: v.made_date(F.col("date")["ts"], p)
    changed = r.withColumns({
        "unrecognized": odd(0, F.concat("unrecognized", F.array(extra)), "unrecognized"),
        "segment_origin_id": odd(1, F.lit("urn:x:origin"), "segment_origin_id"),
        "warcinfo_id": odd(2, F.lit("no uri"), "warcinfo_id"),
        "version": odd(3, F.lit("1.0"), "version"),
        "date": F.when(F.col("record_type") == "request", date("minute")).when(answer & (F.col("k") == 3), date("day")).otherwise(F.col("date")),
        "block_digest": odd(4, v.digest(F.lit("md5:" + "0" * 32)), "block_digest"),
        "target_uri": odd(5, F.lit(None).cast("string"), "target_uri"),
        "ip_address": F.when(answer, "2001:db8::1").otherwise(F.col("ip_address")),
        "concurrent_to": F.when(answer, F.concat("concurrent_to", F.array(F.lit("urn:x:second")))).otherwise(F.col("concurrent_to")),
        "content_type": F.when(answer, F.struct(F.col("content_type")["type"].alias("type"), F.col("content_type")["subtype"].alias("subtype"), F.concat(
            F.col("content_type")["parameters"], F.array(note)).alias("parameters"))).otherwise(F.col("content_type")),
        "filename": F.when(name.isNotNull(), F.struct(name.alias("content"), F.lit(True).alias("quoted"), F.lit(True).alias("utf8"))),
    })
    listed = F.col("record_type") == "metadata"
    null = F.lit(None)
    changed = changed.withColumns({
        "body_fields": F.when(listed, wf.push(F.col("body_fields"), "via", F.col("target_uri"))).otherwise(F.col("body_fields")),
        "body": F.when(listed, null).otherwise(F.col("body")), "content_length": F.when(listed, null).otherwise(F.col("content_length")),
        "block_digest": F.when(listed, null).otherwise(F.col("block_digest"))})
    out = synth.settled(to_raw(changed, keep=["record_id"]))
    path = new_folder(spark, "archive")
    write_warc(out.where(F.col("error").isNull()).select("version", "headers", "body"), path, level=1)
    line = lambda h: F.concat(h["name"], F.lit(":"), h["value"].cast("string"))
    again = read_warc(spark, path).select(
        merge.normal_id(grammar.get("WARC-Record-ID")).alias("record_id"), F.lit(None).cast("string").alias("error"), F.array_join(F.transform("headers", line), "|").alias("header"), F.sha2("body", 256).alias("block"))
    refused = out.where(F.col("error").isNotNull()).select(
        "record_id", F.col("error")["code"].alias("error"), F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("block"))
    return again.unionByName(refused)


@query(f"SELECT record_id, sha256(body) AS block FROM ({RECORDS}) WHERE record_type IN ('response', 'request') AND starts_with(target_uri, 'https://') AND NOT contains(target_uri, '/1')")
def pushed_filter(spark, sf_dir):
    """Filters that the reader takes: blocks of other records are passed over."""
    raw = read_warc(spark, synth.archive(spark, sf_dir, "none"), push=True)
    kept = raw.where(F.col("record_type").isin("response", "request") & F.col("target_uri").startswith("https://") & ~F.col("target_uri").contains("/1"))
    return kept.select("record_id", F.sha2("body", 256).alias("block"))


@query(f"""SELECT record_id, NULL AS code, sha256(body) AS block FROM ({RECORDS}) WHERE record_type = 'metadata'
UNION ALL SELECT {sql_urn("'r' || page_id::VARCHAR")}, 'MalformedField', NULL FROM pages WHERE (page_id % 50) % 9 = 3
UNION ALL SELECT {sql_urn("'r' || page_id::VARCHAR")}, 'MalformedField', NULL FROM pages WHERE (page_id % 50) % 9 = 5""")
def filter_in_reader(spark, sf_dir):
    """Metadata records, and every record whose header breaks its grammar, blocks of others left unread."""
    from ..sources.warc import Wanted

    path = new_folder(spark, "archive")
    write_warc(faulty(spark, sf_dir), path, level=1)
    got = grammar.filter_untyped(spark, path, [Wanted("record_type", "=", "metadata")])
    return got.select("record_id", F.col("error")["code"].alias("code"), F.when(F.col("error").isNull(), F.sha2("body", 256)).alias("block"))


_IN_ONE_FILE = f"""SELECT record_id, body, row_number() OVER (ORDER BY page_id // 50, CASE record_type WHEN 'warcinfo' THEN 0 ELSE (page_id % 50) * 3 + CASE record_type WHEN 'request' THEN 1 WHEN 'response' THEN 2 ELSE 3 END END) - 1 AS place
  FROM ({RECORDS})"""


def in_one_file(spark, sf_dir, compression):
    path = new_folder(spark, "archive")
    return path, write_one(captures(spark, sf_dir).orderBy("file_no", "place"), path, compression, level=1)


@query(f"SELECT place AS record_index, record_id, sha256(body) AS block, true AS several FROM ({_IN_ONE_FILE})")
def split_records(spark, sf_dir):
    """One packed archive, read in many ranges."""
    from ..sources import splits

    path, _ = in_one_file(spark, sf_dir, "gzip")
    index = synth.settled(splits.split_index(spark, path, 16 << 10))
    rows, several = splits.read_ranges(index), index.count() > 1
    return rows.select("record_index", merge.normal_id(grammar.get("WARC-Record-ID")).alias("record_id"), F.sha2("body", 256).alias("block"), F.lit(several).alias("several"))


@query(f"SELECT place AS record_index, record_id, sha256(body) AS block, true AS stored FROM ({_IN_ONE_FILE})")
def records_by_place(spark, sf_dir):
    """Every record by the place and length that writing gave it, and the digest of what is stored there."""
    from ..sources import splits
    from ..sources.warc import to_bytes

    _, written = in_one_file(spark, sf_dir, "none")
    got = to_bytes(splits.read_places(written.withColumn("place", F.col("record_index")), keep=["place", "stored_digest"]))
    return got.select(F.col("place").alias("record_index"), merge.normal_id(grammar.get("WARC-Record-ID")).alias("record_id"), F.sha2("body", 256).alias("block"),
                      (F.concat(F.lit("sha256:"), F.sha2("warc_bytes", 256)) == F.col("stored_digest")).alias("stored"))


@query(f"""SELECT {sql_urn("'g' || doc_id::VARCHAR || '-1'")} AS record_id, greatest(1, ((strlen(coalesce(text, '')) + CASE WHEN coalesce(text, '') = '' THEN 52 ELSE 58 + length(to_hex(strlen(text))) - 2 END) + 699) // 700)::BIGINT AS segments,
  strlen(coalesce(text, ''))::BIGINT AS payload_bytes, 'sha256:' || sha256(coalesce(text, '')) AS payload_digest, NULL::VARCHAR AS error FROM documents""")
def segment_payloads(spark, sf_dir):
    """Chunked messages in segments of 700 bytes: the payload's digest, read piece by piece."""
    from ..functions.chunks import segment_payloads as payloads

    text = F.coalesce("text", F.lit("")).cast("binary")
    head = F.lit(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n")
    chunk = F.when(F.length(text) > 0, F.concat(F.lower(F.hex(F.length(text))).cast("binary"), F.lit(b"\r\n"), text, F.lit(b"\r\n"))).otherwise(F.lit(b""))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, chunk, F.lit(b"0\r\n\r\n")).alias("b"))
    d = d.select("doc_id", "b", F.explode(F.sequence(F.lit(1), F.ceil(F.length("b") / 700).cast("int"))).alias("n"))
    ident = lambda i: urn(F.concat(F.lit("g"), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string")))
    common = {"date": day("doc_id"), "target_uri": F.concat(F.lit("http://example.org/"), F.col("doc_id").cast("string")), "body": F.substring("b", (F.col("n") - 1) * 700 + 1, F.lit(700)),
              "segment_number": F.col("n").cast("string")}
    first = build(d.where("n = 1"), "response", record_id=ident(F.lit(1)), **common)
    rest = build(d.where("n > 1"), "continuation", record_id=ident(F.col("n")), segment_origin_id=ident(F.lit(1)), **common)
    raw = loose(render(first.unionByName(rest, allowMissingColumns=True)))
    return payloads(headers_of(raw)).select("record_id", "segments", "payload_bytes", "payload_digest", "error")


@query(f"""WITH p AS (SELECT page_id, page_id % 6 AS k, {sql_urn("'q' || page_id::VARCHAR")} AS q, {sql_urn("'r' || page_id::VARCHAR")} AS r, {sql_urn("'m' || page_id::VARCHAR")} AS m FROM pages)
SELECT CASE k WHEN 0 THEN r WHEN 1 THEN r WHEN 2 THEN m WHEN 3 THEN q WHEN 4 THEN q END AS record_id, CASE k WHEN 0 THEN 'structure' WHEN 1 THEN 'digest' WHEN 2 THEN 'reference' WHEN 3 THEN 'id' WHEN 4 THEN 'segment' END AS "check",
  CASE k WHEN 2 THEN 'no record has the id urn:x:nowhere' WHEN 4 THEN 'the series has no origin' END AS message FROM p WHERE k < 5""")
def verify_archive(spark, sf_dir):
    """All checks over an archive in which each page's capture has the fault of its class: a lost field, a wrong digest, a reference into nowhere, a copied record, a segment without origin."""
    from ..operators.verify import verify

    c = captures(spark, sf_dir)
    k, kind, headers = F.col("page_id") % 6, F.col("record_type"), F.col("headers")
    segment = F.transform(headers, lambda h: F.struct(h["name"].alias("name"), F.when(F.lower(h["name"]) == "warc-type", F.lit(b" continuation")).otherwise(h["value"]).alias("value")))
    gone = F.concat(F.lit(" <urn:x:gone-"), F.col("page_id").cast("string"), F.lit(">"))
    lone = F.array(*[F.struct(F.lit(n).alias("name"), t.cast("binary").alias("value")) for n, t in (("WARC-Segment-Number", F.lit(" 2")), ("WARC-Segment-Origin-ID", gone))])
    kept = F.filter(segment, lambda h: ~F.lower(h["name"]).isin("warc-concurrent-to", "warc-ip-address"))
    changed = (F.when((k == 0) & (kind == "response"), _drop(headers, "WARC-Target-URI")).when((k == 1) & (kind == "response"), _swap(headers, "WARC-Payload-Digest", "md5:" + "0" * 32))
               .when((k == 2) & (kind == "metadata"), _swap(headers, "WARC-Concurrent-To", "<urn:x:nowhere>")).when((k == 4) & (kind == "request"), F.concat(kept, lone)).otherwise(headers))
    rows = c.withColumn("headers", F.when(kind == "warcinfo", headers).otherwise(changed)).withColumn(
        "copies", F.when((k == 3) & (kind == "request"), 2).otherwise(1)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    path = new_folder(spark, "archive")
    write_warc(rows.repartition("file_no").sortWithinPartitions("file_no", "place", "copy"), path, level=1)
    found = verify(spark, path).where(~F.col("message").startswith("no record has the id urn:x:gone"))
    shown = F.when(F.col("check").isin("reference", "segment"), F.col("message"))
    return found.select("record_id", "check", shown.alias("message"))


@query("""WITH k AS (SELECT page_id, page_id % 7 AS k, length(url) AS n, regexp_extract(url, '^[a-z]+') AS scheme FROM pages)
SELECT page_id, CASE k WHEN 1 THEN 'UnreadableValue' WHEN 2 THEN 'RepeatedField' WHEN 3 THEN 'UnknownChoice' WHEN 4 THEN 'MissingField' END AS code,
  CASE k WHEN 1 THEN 'size' WHEN 2 THEN 'size' WHEN 3 THEN 'scheme' WHEN 4 THEN 'size' END AS field,
  CASE WHEN k IN (0, 5, 6) THEN 'size: ' || n::VARCHAR || '|ratio: ' || CASE WHEN page_id % 2 = 0 THEN (page_id // 2)::VARCHAR ELSE (page_id // 2)::VARCHAR || '.5' END || '|scheme: ' || scheme || '|seen: 1|seen: 2|'
    || CASE WHEN k = 5 THEN 'x-page: ' || page_id::VARCHAR || '|X-Other: y|' ELSE '' END END AS lines FROM k""")
def typed_bodies(spark, sf_dir):
    """Named fields of pages read into typed values with a map of the rest, and written again."""
    from ..functions import typed
    from ..functions.typed import Field

    schema = [Field("size", "uint32"), Field("ratio", "float", required=False), Field("scheme", choices=("http", "https")), Field("seen", "int16", many=True)]
    k, i = F.col("page_id") % 7, F.col("page_id")
    f = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("string").alias("value"))
    size = F.length("url").cast("string")
    no = F.array().cast("array<struct<name: string, value: string>>")
    fields = F.concat(
        F.array(f("SEEN", F.lit("1"))), F.when(k == 4, no).when(k == 1, F.array(f("size", F.concat(size, F.lit(" bytes"))))).when(k == 2, F.array(f("size", size), f("Size", size))).otherwise(F.array(f("size", size))),
        F.array(f("scheme", F.when(k == 3, "ftp").otherwise(F.regexp_extract("url", "^[a-z]+", 0))), f("seen", F.lit("+2")), f("Ratio", (i / 2))),
        F.when(k == 5, F.array(f("x-page", i), f("X-Other", F.lit("y")))).otherwise(no))
    r = table(spark, sf_dir, "pages").select("page_id", typed.read(fields, schema, rest=True).alias("r"))
    w = r.withColumn("w", typed.write(F.col("r")["value"], schema, F.col("r")["rest"]))
    return w.select("page_id", F.col("r")["error"]["code"].alias("code"), F.col("r")["error"]["field"].alias("field"),
                    F.when(F.col("r")["error"].isNull(), F.regexp_replace(wf.render(F.col("w")["fields"]).cast("string"), "\r\n", "|")).alias("lines"))


@query(f"""SELECT {sql_urn("'v' || doc_id::VARCHAR")} AS record_id, CASE WHEN doc_id % 3 = 0 AND coalesce(text, '') <> '' THEN 'UndeclaredRevisitTruncation' END AS code FROM documents""")
def revisit_truncation(spark, sf_dir):
    """Revisits of equal payloads with a block: those that don't say that it is cut to a length."""
    d = table(spark, sf_dir, "documents").withColumn("b", F.coalesce("text", F.lit("")).cast("binary"))
    k = F.col("doc_id") % 3
    rows = build(d, "revisit", record_id=urn(key("v", "doc_id")), date=day("doc_id"), target_uri=F.concat(F.lit("http://example.org/"), F.col("doc_id").cast("string")), body=F.col("b"),
                 profile=F.when(k == 2, "http://netpreserve.org/warc/1.1/revisit/server-not-modified").otherwise("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                 payload_digest=digests.sha256_digest(F.col("b")), truncated=F.when(k == 1, "length"))
    return records(loose(render(rows))).select("record_id", F.col("error")["code"].alias("code"))


@query(f"""SELECT {sql_urn("'w' || page_id::VARCHAR")} AS record_id, 'Ada <' || page_id::VARCHAR || '@example.org>' AS operator, 'crawler/' || page_id::VARCHAR AS software, CASE WHEN page_id % 2 = 0 THEN 'obey' END AS robots,
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS hostname, CASE page_id % 3 WHEN 0 THEN '192.0.2.' || (page_id % 256)::VARCHAR WHEN 1 THEN '2001:db8::' || (page_id % 10)::VARCHAR END AS ip,
  'agent ' || page_id::VARCHAR AS user_agent, NULL::VARCHAR AS from_address FROM pages""")
def warcinfo_fields(spark, sf_dir):
    """The named fields of warcinfo records as columns; an address that is none is null."""
    i = F.col("page_id").cast("string")
    ip = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("192.0.2."), (F.col("page_id") % 256).cast("string"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("2001:db8::"), (F.col("page_id") % 10).cast("string"))).otherwise("nowhere")
    body = wf.warcinfo_body(operator=(F.lit("Ada"), F.concat(i, F.lit("@example.org"))), software=(F.lit("crawler"), i), robots=F.when(F.col("page_id") % 2 == 0, "obey"),
                            hostname=F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), ip=ip, user_agent=F.concat(F.lit("agent "), i))
    rows = build(table(spark, sf_dir, "pages"), "warcinfo", record_id=urn(key("w", "page_id")), date=day("page_id"), body_fields=body)
    out = wf.warcinfo_columns(records(loose(render(rows))))
    return out.select("record_id", "operator", "software", "robots", "hostname", "ip", "user_agent", "from_address")


@query(f"""SELECT page_id, sha256('POST ' || url || ' HTTP/1.1' || {NL} || 'Host: ' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || {NL} || 'X-A: b' || {NL}
  || CASE WHEN page_id % 2 = 0 THEN 'Content-Length: ' || strlen(html)::VARCHAR || {NL} ELSE '' END || {NL} || CASE WHEN page_id % 2 = 0 THEN html ELSE '' END) AS block FROM pages""")
def rebuilt_requests(spark, sf_dir):
    """Requests put together anew: no transfer-coding, and the length of what is sent."""
    fields = F.array(*[F.struct(F.lit(n).alias("name"), t.alias("value")) for n, t in (
        ("Host", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)), ("Transfer-Encoding", F.lit("chunked")), ("X-A", F.lit("b")), ("content-length", F.lit("1")))])
    sent = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(http.request_block(F.lit("POST"), F.col("url"), fields, sent), 256).alias("block"))

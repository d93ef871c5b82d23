"""WARC derivatives: response records into linked metadata and plain-text conversion records.

Only DataFrame functions; one pass over the responses without a shuffle. Record ids are name-based, so a repeated run
gives the same records. Digests are labelled ``sha256:`` with hexadecimal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that both Java and RE2 read alike.
DROPPED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<head\b.*?</head\s*>"
BREAKS = r"(?i)</?(p|br|div|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|article|section|nav|header|footer|title|blockquote|pre)\b[^>]*>"
TAGS = r"<[^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANGUAGE = r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)"""
LINKS = r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"'>]*)["']"""
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
DATE = "1970-01-01T00:00:00Z"


def urn(*parts: Column) -> Column:
    """A name-based record id from the MD5 digest of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def squeezed(text: Column) -> Column:
    """Runs of blanks become one, lines lose blanks at both ends, empty lines go."""
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def plain_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and the head go, block tags become line ends, entities are decoded."""
    text = F.regexp_replace(F.regexp_replace(html, DROPPED, " "), BREAKS, "\n")
    return squeezed(decoded(F.regexp_replace(text, TAGS, "")))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of ``pages`` (page_id, url, html): id, target, date, header block, payload and its digest.

    Null html is an empty payload; a null url an empty target.
    """
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    base = pages.select("page_id", url.alias("target_uri"), html.alias("payload"))
    return base.select(
        "page_id",
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", "payload").alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")).alias("http_headers"),
        "payload",
        digest(F.col("payload")).alias("payload_digest"),
    )


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for each response: ``metadata`` (warc-fields: title, language, outlinks) and ``conversion`` (plain text).

    Both point to their response (``refers_to``, with its target and date) and to each other (WARC-Concurrent-To), keep its
    HTTP header block (a WARC-Source-Header line for each of its lines) and payload digest, and carry ids, type, length
    and digest of their own block; ``headers`` has all this as WARC lines.
    An empty payload gives an empty conversion; repeated responses give repeated records. Other columns aren't read.
    """
    title = F.regexp_replace(squeezed(decoded(F.regexp_extract("payload", TITLE, 1))), r"\n", " ")
    language = F.lower(F.regexp_extract("payload", LANGUAGE, 1))
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINKS), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(decoded(x), r"[\r\n]+", " "), F.lit(" L a/@href\r\n")))
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), language, F.lit("\r\n"), F.array_join(links, ""))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    both = records.select(
        key,
        F.col("record_id").alias("refers_to"),
        F.col("target_uri").alias("refers_to_target_uri"),
        F.col("date").alias("refers_to_date"),
        F.col("http_headers").alias("source_headers"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.inline(kinds),
    )
    own = both.withColumn("record_id", urn(F.col("record_type"), F.col("refers_to"))).withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    twin = urn(F.when(F.col("record_type") == "metadata", "conversion").otherwise("metadata"), F.col("refers_to"))
    own = own.withColumn("_twin", twin)
    source = F.transform(F.filter(F.split("source_headers", "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("WARC-Source-Header: "), x, F.lit("\r\n")))
    lines = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "refers_to_date"), ("WARC-Target-URI", "refers_to_target_uri"),
        ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"),
        ("WARC-Refers-To-Payload-Digest", "source_payload_digest"), ("WARC-Concurrent-To", "_twin"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    quoted = lambda name, col: F.concat(F.lit("<"), F.col(col), F.lit(">")) if name in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To") else F.col(col).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{n}: "), quoted(n, c), F.lit("\r\n")) for n, c in lines], F.array_join(source, ""), F.lit("\r\n"))
    return own.withColumn("headers", head).drop("_twin")


def serialised(records: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, record_type, record): each derivative as the bytes of a WARC record, ready to be joined to a file."""
    return records.select(key, "record_type", F.encode(F.concat("headers", "block", F.lit("\r\n\r\n")), "UTF-8").alias("record"))


COLUMNS = ["page_id", "record_type", "record_id", "refers_to", "refers_to_target_uri", "source_headers", "source_payload_digest", "content_type", "content_length", "block_digest", "headers", "block"]


def _duck_text(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _duck_squeezed(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({x}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


def _duck_urn(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    return f"'urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PLAIN = _duck_squeezed(_duck_text(f"regexp_replace(regexp_replace(regexp_replace(payload, {_q(DROPPED)}, ' ', 'g'), {_q(BREAKS)}, chr(10), 'g'), {_q(TAGS)}, '', 'g')"))
_TITLE = f"regexp_replace({_duck_squeezed(_duck_text(f'regexp_extract(payload, {_q(TITLE)}, 1)'))}, '\\n', ' ', 'g')"
_LINKS = f"array_to_string(list_transform(regexp_extract_all(payload, {_q(LINKS)}, 1), lambda x: 'outlink: ' || regexp_replace({_duck_text('x')}, '[\\r\\n]+', ' ', 'g') || ' L a/@href' || chr(13) || chr(10)), '')"
_NL = "chr(13) || chr(10)"
ORACLE = f"""
WITH r0 AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (
  SELECT page_id, target_uri, payload, {_duck_urn("'response'", "coalesce(page_id::VARCHAR, '')", 'target_uri', 'payload')} AS refers_to,
         'HTTP/1.1 200 OK' || {_NL} || 'Content-Type: text/html; charset=utf-8' || {_NL} || 'Content-Length: ' || strlen(payload) || {_NL} || {_NL} AS source_headers,
         'sha256:' || sha256(payload) AS source_payload_digest FROM r0),
m AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || {_TITLE} || {_NL} || 'language: ' || lower(regexp_extract(payload, {_q(LANGUAGE)}, 1)) || {_NL} || {_LINKS} AS block FROM r
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {_PLAIN} FROM r),
d AS (SELECT *, {_duck_urn('record_type', 'refers_to')} AS record_id, {_duck_urn("CASE record_type WHEN 'metadata' THEN 'conversion' ELSE 'metadata' END", 'refers_to')} AS twin, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM m)
SELECT page_id, record_type, record_id, refers_to, target_uri AS refers_to_target_uri, source_headers, source_payload_digest, content_type, content_length, block_digest,
  'WARC/1.1' || {_NL} || 'WARC-Type: ' || record_type || {_NL} || 'WARC-Record-ID: <' || record_id || '>' || {_NL} || 'WARC-Date: {DATE}' || {_NL} || 'WARC-Target-URI: ' || target_uri || {_NL}
  || 'WARC-Refers-To: <' || refers_to || '>' || {_NL} || 'WARC-Refers-To-Target-URI: ' || target_uri || {_NL} || 'WARC-Refers-To-Date: {DATE}' || {_NL}
  || 'WARC-Refers-To-Payload-Digest: ' || source_payload_digest || {_NL} || 'WARC-Concurrent-To: <' || twin || '>' || {_NL}
  || 'WARC-Block-Digest: ' || block_digest || {_NL} || 'Content-Type: ' || content_type || {_NL} || 'Content-Length: ' || content_length || {_NL} || array_to_string(list_transform(list_filter(string_split(source_headers, {_NL}), lambda x: x <> ''), lambda x: 'WARC-Source-Header: ' || x || {_NL}), '') || {_NL} AS headers, block
FROM d
"""

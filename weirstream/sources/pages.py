"""Links in web pages, cookies and key lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import resolve
from . import fetch


#: Names of attributes that link to media; longer names that end so count as well.
LINKING = ("src", "href", "file", "source", "content")


def _attribute_values(markup: Column, names: tuple[str, ...]) -> Column:
    """Quoted values of attributes with these names, in order."""
    rx = F.lit(r"""([\w-]+)\s*=\s*["']([^"']*)["']""")
    pairs = F.arrays_zip(F.regexp_extract_all(markup, rx, 1).alias("name"), F.regexp_extract_all(markup, rx, 2).alias("value"))
    return F.transform(F.filter(pairs, lambda x: x["name"].rlike("(?:" + "|".join(names) + ")$")), lambda x: x["value"])


def links(page: Column, suffixes: str = "m3u8|mpd") -> Column:
    """Distinct links to files of these types: all absolute addresses first, then attribute values; slashes unescaped.

    An address is cut behind its file type and query; an attribute's whole value
    has to end with them.
    """
    text = F.replace(page, F.lit("\\/"), F.lit("/"))
    addresses = F.regexp_extract_all(text, F.lit(r"""https?://[^\s"'<>\\]+"""), 0)
    cut = F.transform(addresses, lambda a: F.regexp_extract(a, rf"^.{{9,}}?\.(?:{suffixes})(?:\?.*)?", 0))
    values = F.filter(_attribute_values(text, LINKING), lambda v: v.rlike(rf"(?s)^.+?\.(?:{suffixes})(?:\?.*)?$"))
    return F.array_distinct(F.filter(F.concat(cut, values), lambda x: x != ""))


def page_links(pages: DataFrame, suffixes: str = "m3u8|mpd") -> DataFrame:
    """page_id, place, link: links of each page as seen from its URL, in order, without repeats."""
    rows = pages.select("page_id", "url", F.posexplode(links(F.col("html"), suffixes)).alias("place", "link"))
    return rows.select("page_id", "place", resolve(F.col("url"), F.trim("link")).alias("link")).groupBy("page_id", "link").agg(F.min("place").alias("place")).select("page_id", "place", "link")


def iframes(page: Column) -> Column:
    """Addresses of a page's frames, but for about: ones."""
    tags = F.regexp_extract_all(page, F.lit("<iframe([^>]*)"), 1)
    return F.filter(F.flatten(F.transform(tags, lambda t: F.slice(_attribute_values(t, ("src",)), 1, 1))), lambda x: (x != "") & ~x.startswith("about:"))


def found_links(pages: DataFrame, fetched: DataFrame, suffixes: str = "m3u8|mpd") -> DataFrame:
    """page_id, place, link: a page's own links, or if it has none those of its frames, one level deep.

    ``fetched`` (url, html) holds the bodies of frames; those it lacks give nothing.
    """
    # each page is read once: its own links, and its frames where it has none
    read = pages.select("page_id", "url", links(F.col("html"), suffixes).alias("found"), iframes(F.col("html")).alias("frames"))
    both = read.select("page_id", "url", F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("frames")).alias("refs"), (F.size("found") > 0).alias("own"))
    refs = both.select("page_id", "url", "own", F.posexplode("refs").alias("place", "ref")).withColumn("link", resolve(F.col("url"), F.trim("ref")))
    own = refs.filter("own").groupBy("page_id", "link").agg(F.min("place").alias("place")).select("page_id", "place", "link")
    frames = refs.filter("NOT own").select("page_id", F.col("place").alias("frame"), F.col("link").alias("url")).join(fetched.select("url", "html"), "url")
    inside = frames.select("page_id", "frame", "url", F.posexplode(links(F.col("html"), suffixes)).alias("n", "link"))
    inside = inside.select("page_id", F.struct("frame", "n").alias("at"), resolve(F.col("url"), F.trim("link")).alias("link")).groupBy("page_id", "link").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1
    return own.unionByName(inside.select("page_id", place.alias("place"), "link"))


def cookies(lines: DataFrame) -> DataFrame:
    """Rows of a cookies.txt (line): domain, subdomains, path, secure, expires, name, value."""
    clean = F.regexp_replace("line", "^#HttpOnly_", "")
    parts = F.split(clean, "\t")
    rows = lines.select(clean.alias("l"), parts.alias("f")).filter((F.size("f") >= 7) & ~F.col("l").startswith("#"))
    get = lambda i: F.col("f")[i]
    return rows.select(
        F.lower(F.regexp_replace(get(0), r"^\.", "")).alias("domain"), (F.upper(get(1)) == "TRUE").alias("subdomains"), get(2).alias("path"), (F.upper(get(3)) == "TRUE").alias("secure"),
        F.coalesce(get(4).try_cast("bigint"), F.lit(0)).alias("expires"), get(5).alias("name"), get(6).alias("value"),
    )


def cookies_for(urls: DataFrame, jar: DataFrame) -> DataFrame:
    """url, name, value of the cookies that go with each URL.

    Hosts are taken apart into their parent domains, so that the match on the
    domain is an equi-join; path and secure flag are checked after it.
    """
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    path = F.coalesce(F.nullif(F.parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/"))
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rows = urls.select("url", host.alias("host"), path.alias("url_path"), F.explode(parents).alias("domain"))
    return rows.join(jar, "domain").filter(F.col("url_path").startswith(F.col("path")) & (~F.col("secure") | F.col("url").startswith("https:"))).select("url", "name", "value")


def keys(lines: DataFrame) -> DataFrame:
    """kid, key (binary) of KID:KEY texts (``spec``); dashes in the KID are optional, a bare key has the zero KID; bad ones go."""
    both = F.contains("spec", F.lit(":"))
    kid = F.when(both, F.replace(F.split_part("spec", F.lit(":"), F.lit(1)), F.lit("-"), F.lit(""))).otherwise(F.lit("0" * 32))
    key = F.when(both, F.split_part("spec", F.lit(":"), F.lit(2))).otherwise(F.col("spec"))
    good = "^[0-9A-Fa-f]{32}$"
    return lines.filter(kid.rlike(good) & key.rlike(good)).select(F.unhex(kid).alias("kid"), F.unhex(key).alias("key"))


def resolve_keys(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``wanted`` (stream_id, tenc_kid, manifest_kid) with ``key``: by the first KID that hits, else the only key if it has the zero KID.

    A KID that ``known`` (kid, key) has more than once counts with its least key.
    """
    known = known.groupBy("kid").agg(F.min("key").alias("key"))
    lookup = lambda c: known.select(F.col("kid").alias(c), F.col("key").alias(f"key_of_{c}"))
    zero = F.unhex(F.lit("0" * 32))
    only = known.agg(F.when((F.count(F.lit(1)) == 1) & (F.max("kid") == zero), F.max("key")).alias("only"))  # one row
    rows = wanted.join(lookup("tenc_kid"), "tenc_kid", "left").join(lookup("manifest_kid"), "manifest_kid", "left").join(F.broadcast(only))
    return rows.select("stream_id", F.coalesce("key_of_tenc_kid", "key_of_manifest_kid", "only").alias("key"))


def data_uri_keys(uris: DataFrame) -> DataFrame:
    """uri, key of distinct ``data:`` URIs (uri): base64 or plain; keys that don't have 16 bytes are null."""
    rows = uris.select("uri").distinct().filter(F.col("uri").startswith("data:"))
    head, payload = F.regexp_extract("uri", "^([^,]*),", 1), F.regexp_extract("uri", "^[^,]*,(?s)(.*)$", 1)
    key = F.when(F.contains(head, F.lit("base64")), F.try_to_binary(payload, F.lit("base64"))).otherwise(payload.cast("binary"))
    return rows.select("uri", F.when(F.octet_length(key) == 16, key).alias("key"))


def keys_by_uri(uris: DataFrame, headers: DataFrame | None = None, tasks: int = 8, retries: int = 5, timeout: float = 30.0) -> DataFrame:
    """uri, key, error of all distinct URIs (uri): ``data:`` ones are read, the others fetched, each once. Keys must have 16 bytes; what fails is a row with its error.

    ``headers`` (url, headers map) go with the requests, such as ``cookie_headers``.
    """
    every = uris.select("uri").filter("uri IS NOT NULL AND uri <> ''").distinct()
    plain = data_uri_keys(every).withColumn("error", F.when(F.col("key").isNull(), F.lit("not a key of 16 bytes")))
    asked = every.filter(~F.col("uri").startswith("data:")).select(F.col("uri").alias("url"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"))
    asked = asked.join(headers, "url", "left") if headers is not None else asked.withColumn("headers", F.lit(None).cast("map<string,string>"))
    got = fetch.fetched(asked.repartition(tasks, "url"), retries, timeout)
    whole = F.octet_length("body") == 16
    error = F.when(F.col("body").isNull(), F.concat(F.lit("not fetched: status "), F.col("status").cast("string"))).when(~whole, F.concat(F.lit("key of "), F.octet_length("body").cast("string"), F.lit(" bytes")))
    return plain.unionByName(got.select(F.col("url").alias("uri"), F.when(whole, F.col("body")).alias("key"), error.alias("error")))


def cookie_headers(urls: DataFrame, jar: DataFrame) -> DataFrame:
    """url, headers: the ``Cookie`` header of each URL that cookies go with, in the order of their names and values."""
    pairs = F.array_sort(F.collect_list(F.concat("name", F.lit("="), F.col("value"))))
    return cookies_for(urls.select("url").distinct(), jar).groupBy("url").agg(F.create_map(F.lit("Cookie"), F.array_join(pairs, "; ")).alias("headers"))


def with_keys(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Segments with ``aes_key`` by their key's URI, and ``key_error`` if ``keys`` has errors; each URI is looked up once."""
    told = [F.col("error").alias("key_error")] if "error" in keys.columns else []
    return segments.withColumn("uri", F.col("key.uri")).join(keys.select("uri", F.col("key").alias("aes_key"), *told), "uri", "left").drop("uri")

"""Queries over live sources, keyed state, ordered files and the packet cipher."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import views
from .functions import binary, scalars
from .operators import jobs, telemetry
from .plans import select
from .scratch import folder, replayed
from .sources import dash, fetch, pages, subtitles, transport
from .streaming import files, ordering, polling, sink
from .views import table, with_views

K = F.col


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def live_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four refreshes of every user's playlist, a window of a third of its segments that moves on, polled and parsed: what is new, from the live edge on."""
    rows = views.segments(spark, sf_dir).select("stream_id", "seg_ord", "url")
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("seg_ord"))
    rows = rows.withColumn("i", place).withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("stream_id")))
    n = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")
    end = F.ceil(K("count") * (K("n") + 1) / 4)
    shown = rows.select("*", n).filter((K("i") <= end) & (K("i") > end - F.ceil(K("count") / 3)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", _text("#EXTINF:2,\n", K("url"), "\n").alias("l")))), lambda x: x["l"]), "")
    bodies = shown.groupBy("stream_id", "n").agg(body.alias("b"))
    tail = F.when(K("n") == 3, F.lit("#EXT-X-ENDLIST\n")).otherwise(F.lit(""))
    root = folder(spark, "poll")
    recorded = bodies.select(K("stream_id").cast("string").alias("stream_id"), "n", _text("https://ex.com/", K("stream_id"), "/live.m3u8").alias("url"), F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:4\n"), "b", tail).alias("body"))
    recorded.write.partitionBy("n").parquet(f"{root}/recorded")
    known = recorded.select("stream_id").distinct().withColumn("id", F.lit(None).cast("string"))
    feed = polling.Feed(spark, known, f"{root}/feed", {"snapshots": f"{root}/recorded", "refreshes": "4"})
    fetching = feed.refreshing()
    try:
        fetching.processAllAvailable()
    finally:
        fetching.stop()
    out = feed.fresh(["/error-"]).select("stream_id", "url").writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    out.awaitTermination()
    return spark.read.schema("stream_id string, url string").parquet(f"{root}/out")


def _scrambled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes in another order than their indexes."""
    return views.outcomes(spark, sf_dir).select("stream_id", F.pmod(F.xxhash64("stream_id", "idx"), F.lit(1000)).alias("came"), "idx", "ok")


def commit_live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that come in any order, committed in theirs; failures are holes."""
    ordering.use_rocksdb(spark)
    return replayed(_scrambled(spark, sf_dir), lambda s: ordering.in_order(s.drop("came"))).filter("NOT hole").select("stream_id", "idx")


def commit_prefix_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with failures that hold up what follows."""
    ordering.use_rocksdb(spark)
    return replayed(_scrambled(spark, sf_dir), lambda s: ordering.in_order(s.drop("came"), live=False)).select("stream_id", "idx")


def stop_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that end by their taken duration, because they aren't live any more or were asked to, as keyed state."""
    e = K("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), e.alias("n"), (e % 5).cast("double").alias("duration"), (e % 97 != 3).alias("live"), (e % 89 == 5).alias("asked_to_stop"))
    ordering.use_rocksdb(spark)
    return replayed(rows, lambda s: ordering.until_stop(s, 40.0)).select("stream_id", "n", "last")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event a piece, in a file for each user."""
    e = table(spark, sf_dir, "events")
    ok = views.outcomes(spark, sf_dir)
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    data = _text(K("event_id"), " ", F.repeat(K("event_type"), (K("event_id") % 7).cast("int")), "\n").cast("binary")
    rows = e.select(K("user_id").alias("stream_id"), idx.alias("idx"), data.alias("data")).join(ok, ["stream_id", "idx"])
    return rows.select(_text("user-", K("stream_id"), ".ts").alias("stream"), "idx", "ok", "data")


def _digests(spark: SparkSession, path: str) -> DataFrame:
    """Size and digest of a folder's files."""
    return files.bodies(spark, path, ".ts").select("stream", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("md5"))


def ordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of pieces: written up to each one's first failure, then, with what failed, to the end, and a third time; read as bytes."""
    path = folder(spark, "files").removeprefix("file:")
    pieces = _pieces(spark, sf_dir)
    writer = files.FileSink(path)
    writer.write(pieces, 0)
    writer.write(pieces.withColumn("ok", F.lit(True)), 1)
    writer.write(pieces.withColumn("ok", F.lit(True)), 1)
    return _digests(spark, path).join(files.states(spark, path).select("stream", "next_idx", "offset"), "stream")


def live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live, what failed takes an index and no bytes."""
    path = folder(spark, "files").removeprefix("file:")
    files.append(_pieces(spark, sf_dir), path, live=True)
    return files.states(spark, path).select("stream", "next_idx", "offset")


def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that come in any order, over four batches, put into files by a streaming writer; failures are holes."""
    root = folder(spark, "streamed").removeprefix("file:")
    came = F.pmod(F.xxhash64("stream", "idx"), F.lit(4)).cast("int")
    _pieces(spark, sf_dir).withColumn("part", came).write.partitionBy("part").parquet(f"{root}/in")
    schema = "stream string, idx long, ok boolean, data binary"
    for i in range(4):
        source = spark.readStream.schema(schema).parquet(f"{root}/in/part={'{' + ','.join(map(str, range(i + 1))) + '}'}")
        files.stream_into(source, f"{root}/out", f"{root}/state", availableNow=True).awaitTermination()
    return _digests(spark, f"{root}/out")


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files fetched by ranges of 100 bytes, some of which a first attempt had got, put together."""
    root = folder(spark, "download").removeprefix("file:")
    files.append(_pieces(spark, sf_dir).withColumn("ok", F.lit(True)), f"{root}/there")
    known = files.states(spark, f"{root}/there").select(K("stream").alias("stream_id"), _text(f"file://{root}/there/", K("stream")).alias("url"), K("offset").alias("length"))
    ranges = fetch.file_ranges(known, 100)

    def take(pieces: DataFrame) -> None:
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        got = fetch.fetched(pieces.withColumn("headers", F.lit(None)).repartition(tasks))
        stream = F.element_at(F.split("url", "/"), -1)
        files.append(got.select(stream.alias("stream"), F.expr("span.start div 100").alias("idx"), K("status").isin(200, 206).alias("ok"), K("body").alias("data")), f"{root}/here")

    take(ranges.filter("idx < 3"))
    told = files.states(spark, f"{root}/here").select(K("stream").alias("stream_id"), "next_idx")
    take(ranges.join(told, "stream_id", "left").filter("idx >= coalesce(next_idx, 0)").drop("next_idx"))
    return _digests(spark, f"{root}/here")


def fetched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by URI for orders: data URIs, files of 16 bytes and others, files that aren't there; each URI is asked for once."""
    root = folder(spark, "keys").removeprefix("file:")
    s = table(spark, sf_dir, "supplier").select(K("s_suppkey").alias("k"))
    body = F.when(K("k") % 3 == 0, F.unhex(F.md5(K("k").cast("string").cast("binary")))).otherwise(F.lit("short").cast("binary"))
    files.append(s.filter("k % 5 <> 4").select(_text("key-", K("k")).alias("stream"), F.lit(0).alias("idx"), F.lit(True).alias("ok"), body.alias("data")), root)
    k = K("o_custkey") % 100 + 1
    uri = F.when(K("o_orderkey") % 7 == 0, _text("data:;base64,", F.base64(F.unhex(F.md5(k.cast("string").cast("binary")))))).otherwise(_text(f"file://{root}/key-", k))
    segments = table(spark, sf_dir, "orders").select(K("o_orderkey").alias("id"), F.struct(uri.alias("uri")).alias("key"))
    keys = pages.keys_by_uri(segments.select(K("key.uri").alias("uri")), retries=0)
    rows = pages.with_keys(segments, keys)
    return rows.select("id", F.lower(F.hex("aes_key")).alias("key"), F.coalesce("key_error", F.lit("")).alias("error"))


def _ts_iv(c: Column) -> Column:
    """24 hexadecimal digits of bytes from F8 to FF, which no UTF-8 text holds, so that no start code comes up by chance."""
    return F.regexp_replace(F.translate(F.upper(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 12)), "01234567", "89ABCDEF"), "(.)", "F$1")


def _without_start_codes(load: Column) -> Column:
    """Bytes (hexadecimal) with a 03 put before each that would make a start code, or look like such a 03, after two zeros, as NAL units are written."""
    return F.regexp_replace(load, r"\G((?:..)*?0000)(?=0[0-3])", "$103")


@F.arrow_udf(T.BinaryType())
def _enciphered(plain: pa.Array, iv: pa.Array, under_aes: pa.Array) -> pa.Array:
    """Texts XORed with their counters, of which each tenth and the last are under AES."""

    def one(b: bytes, iv: bytes, under_aes: bytes) -> bytes:
        n = -(-len(b) // 16)
        stream = np.empty((n, 16), np.uint8)
        stream[:, :12] = np.frombuffer(iv, np.uint8)
        stream[:, 12:] = np.arange(1, n + 1).astype(">u4").view(np.uint8).reshape(-1, 4)
        blocks = np.frombuffer(under_aes, np.uint8).reshape(-1, 16)[:-1]  # the last is padding
        stream[::10] = blocks[: -(-n // 10)]
        stream[-1] = blocks[-1]
        return (np.frombuffer(b, np.uint8) ^ stream.ravel()[: len(b)]).tobytes()

    return binary.by_row(one, plain, iv, under_aes)


@F.arrow_udf(T.BinaryType())
def _in_packets(unit: pa.Array, name: pa.Array) -> pa.Array:
    """Units as the one of a video PES in packets, the last filled by an adaptation field, behind a service table with the name and a program map."""
    head = lambda pid, section: b"G" + pid + b"\x10" + section.ljust(184, b"\xff")
    program = head(b"\x50\x00", bytes.fromhex("0002B0120001C10000E100F0001BE100F00000000000"))

    def one(unit: bytes, name: bytes) -> bytes:
        pes = bytes.fromhex("000001E0000080000000000165") + unit + b"\x80\x80"
        n, size = divmod(len(pes), 184)
        packets = np.empty((n, 188), np.uint8)
        packets[:, :4] = 0x47, 0x01, 0x00, 0x10
        packets[:, 4:] = np.frombuffer(pes, np.uint8, n * 184).reshape(n, 184)
        fill = bytes([183 - size]) + (b"\0".ljust(183 - size, b"\xff") if size < 183 else b"")
        last = b"G\x01\x00\x30" + fill + pes[n * 184 :] if size else b""
        services = bytes.fromhex("0042F0400001C1000000" "01FF" "0005FC002F" "482D01002A") + name + b"\0\0\0\0"
        return head(b"\x40\x11", services) + program + packets.tobytes() + last

    return binary.by_row(one, unit, name)


def _ts_sealed(docs: DataFrame) -> DataFrame:
    """stream, segment, iv, plain, data: whole texts as the one NAL unit of a video PES, enciphered under Spark's AES, with tables in front."""
    d = docs.withColumn("plain", F.concat(F.lit("."), F.coalesce("text", F.lit(""))).cast("binary")).withColumn("iv", _ts_iv(K("doc_id")))
    last = F.ceil(F.octet_length("plain") / 16).cast("int") - 1
    places = F.array_union(F.sequence(F.lit(0), last, F.lit(10)), F.array(last))
    counters = F.unhex(F.array_join(F.transform(places, lambda i: F.concat("iv", F.lpad(F.hex(i.cast("long") + 1), 8, "0"))), ""))
    under_aes = F.aes_encrypt(counters, F.unhex(F.lit("00112233445566778899AABBCCDDEEFF")), F.lit("ECB"), F.lit("PKCS"))
    d = d.withColumn("cipher", _enciphered("plain", F.unhex("iv"), under_aes))
    name = F.concat(F.lit("mdcm|p|s|?"), "iv", F.lit("00000000")).cast("binary")
    data = _in_packets(F.unhex(_without_start_codes(F.hex("cipher"))), name)
    return d.select(K("doc_id").alias("stream"), F.lit(1).cast("long").alias("segment"), "iv", "plain", data.alias("data"))


@F.arrow_udf(T.BinaryType())
def _payloads(data: pa.Array) -> pa.Array:
    """What the packets behind the two tables carry."""

    def one(b: bytes) -> bytes:
        a = np.frombuffer(b, np.uint8, len(b) // 188 * 188).reshape(-1, 188)[2:]
        start = np.where(a[:, 3] >> 4 == 1, 4, 5 + a[:, 4].astype(np.int64))
        return a[np.arange(188) >= start[:, None]].tobytes()

    return binary.by_row(one, data)


def ts_cipher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts sealed in transport streams and deciphered by the IV that these hold: the texts again, where they were."""
    rows = _ts_sealed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    pieces = rows.select(K("stream").alias("stream_id"), F.octet_length("plain").alias("n"), F.lit(False).alias("is_init"), "data", F.lit(None).cast("binary").alias("aes_key"), F.lit(None).cast("binary").alias("iv"), F.lit(0).alias("seq"), F.unhex(F.lit("00112233445566778899AABBCCDDEEFF")).alias("ts_key"))
    clear = sink.transformed(pieces)
    return clear.select(K("stream_id").alias("doc_id"), K("n").cast("long").alias("n_bytes"), F.md5(F.substr(_payloads("data"), F.lit(14), K("n"))).alias("md5"))


def ts_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transport.services(_ts_sealed(table(spark, sf_dir, "documents").select("doc_id", "text")).filter("stream IS NOT NULL"))
    return rows.select(K("stream").alias("doc_id"), "service", "provider", "name", F.hex("iv").alias("iv"))


def _ts_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of packets, as bytes."""
    packet = F.concat(F.lit("47"), F.lpad(F.hex(K("pid").cast("long")), 4, "0"), F.lpad(F.hex((K("afc") * 16 + K("cc")).cast("long")), 2, "0"), F.repeat(F.lit("AB"), 184))
    rows = views.packets(spark, sf_dir).groupBy("stream", "segment").agg(F.array_sort(F.collect_list(F.struct("pkt_no", packet.alias("h")))).alias("p"))
    return rows.select("stream", "segment", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("data"))


def _counters(segments: DataFrame) -> DataFrame:
    places = F.sequence(F.lit(0), (F.octet_length("data") / 188).cast("int") - 1)
    return segments.select("stream", "segment", F.array_join(F.transform(places, lambda i: F.substr(F.hex("data"), i * 376 + 8, F.lit(1))), "").alias("counters"))


def cc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of segments, rewritten in their rows."""
    return _counters(transport.continued(_ts_segments(spark, sf_dir)))


def cc_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over batches, with the counts so far as keyed state."""
    ordering.use_rocksdb(spark)
    rows = _ts_segments(spark, sf_dir)
    starts = replayed(rows, lambda s: ordering.running_starts(transport.counts_of(s)))
    return _counters(transport.rewritten(rows, starts))


def progress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that tells how far each stream is, half of them live."""
    c = views.outcomes(spark, sf_dir).groupBy("stream_id").agg(F.count_if("ok").alias("done"), F.count(F.lit(1)).alias("total"))
    k = K("stream_id")
    c = c.withColumns({"bytes": K("done") * k * k * 37, "speed": k * 1000.0 + 0.25, "live": k % 2 == 1, "elapsed_s": k * 7.5})
    return telemetry.progress_text(c).select("stream_id", "line")


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output of a job per user, cut at 200 bytes again and again, and its last line of progress."""
    e = K("event_id")
    text = _text(K("event_type"), " ", e, F.when(e % 3 == 0, _text("\n ", e, "/9 segs | x \n")).otherwise(F.lit("\n")))
    return jobs.captured(table(spark, sf_dir, "events").select(K("user_id").alias("id"), e.alias("n"), text.alias("text")), 200)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each customer's job transitions."""
    status = K("o_orderstatus")
    state = F.when(status == "O", F.lit("running")).when(status == "F", F.lit("done")).otherwise(F.lit("error"))
    at = K("o_orderkey")
    events = table(spark, sf_dir, "orders").select(K("o_custkey").alias("id"), at.alias("at"), state.alias("state"), F.when(state == "error", _text("e", at)).otherwise(F.lit("")).alias("error"))
    return jobs.latest(events)


def job_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to stop jobs, answered, and the state that the jobs are in then."""
    known = views.jobs(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(K("c_custkey").alias("request_id"), (K("c_custkey") * 7).alias("id"))
    answers = jobs.stop_answers(asked, known)
    after = jobs.stopped(known, answers).select("id", "state")
    return answers.join(after, "id", "left").select("request_id", "id", "answer", F.coalesce("state", F.lit("")).alias("state"))


SELECTORS = {
    "best2": "rank <= 2", "all": "true", "none": "false", "": "false", "worst3": "last <= 3", "bwmin=905:bwmax=970": "bandwidth BETWEEN 905000 AND 970000", "res=x(720|1080)$": "height IN (720, 1080)",
    "codecs!=steel": "NOT codecs ILIKE '%steel%'", "name=^a:for=all": "name ILIKE 'a%'", "id=7$": "id LIKE '%7'",
    "bwmin=x": None, "nokey=1": None, "for=some": None, "id=(": None, "plistdurmax=soon": None, "lang": None, "segsmin=1.5": None,
}


def selector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What selectors take of the videos of all manifests, and which can't be read."""
    ranked = select.ranked(views.streams(spark, sf_dir)).filter("media_type = 'video'")
    out = None
    for text in SELECTORS:
        try:
            rows = select.applied(ranked, select.parse(text)).agg(F.count(F.lit(1)).alias("hits"), F.lit(True).alias("ok"))
        except select.SelectorError:
            rows = ranked.agg(F.count(F.lit(1)).alias("all")).select(F.lit(0).cast("long").alias("hits"), F.lit(False).alias("ok"))
        rows = rows.select(F.lit(text).alias("selector"), "ok", "hits")
        out = rows if out is None else out.unionByName(rows)
    return out


def dash_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates whose fields come from two levels, and key ids of either, malformed ones passed over."""
    k = K("s_suppkey")
    kid = F.lower(F.md5(k.cast("string").cast("binary")))
    own = F.when(k % 3 == 0, _text('<ContentProtection cenc:default_KID="', kid, '"/>')).when(k % 3 == 1, F.lit('<ContentProtection cenc:default_KID="not-a-kid"/>')).otherwise(F.lit(""))
    body = _text(
        '<MPD xmlns:cenc="urn:mpeg:cenc:2013" mediaPresentationDuration="PT', k % 7 + 9, 'S"><Period><AdaptationSet mimeType="audio/mp4"><ContentProtection cenc:default_KID="00112233-4455-6677-8899-aabbccddeeff"/>',
        '<SegmentTemplate timescale="10" duration="40" startNumber="', k, '" media="outer/$Number$.m4s" initialization="outer/init.mp4"/>',
        '<Representation id="one" bandwidth="5">', own, '<SegmentTemplate media="inner/$RepresentationID$-$Number%04d$.m4s"/></Representation></AdaptationSet></Period></MPD>',
    )
    rows = table(spark, sf_dir, "supplier").select(k.alias("manifest_id"), F.lit("https://ex.com/lib/show.mpd").alias("url"), body.alias("body"))
    return dash.parse_segments(rows).select("manifest_id", "seg_ord", "url", "duration", F.lower(F.hex("kid")).alias("kid"), K("init.url").alias("init_url"))


def dash_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests on demand whose counted template has no length to count to."""
    k = K("s_suppkey")
    length = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit(' mediaPresentationDuration="PT8S"'))
    body = _text("<MPD", length, '><Period><AdaptationSet mimeType="video/mp4"><SegmentTemplate duration="', k % 2 * 4, '" media="s$Number$"/><Representation id="v', k, '"/></AdaptationSet></Period></MPD>')
    rows = table(spark, sf_dir, "supplier").select(k.alias("manifest_id"), F.lit("https://ex.com/a.mpd").alias("url"), body.alias("body"))
    return dash.rejected(rows).select("manifest_id", "track", "reason")


def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files of three kinds, one of them TTML inside fragments, as SRT."""
    e, u = K("event_id"), K("user_id")
    paragraph = _text('<p begin="', e, '.25s" end="', e + 1, '.5s">', K("event_type"), " &amp; <b>", e, "</b></p>")
    clock = lambda s: F.concat(scalars.zero_filled(F.floor(s / 3600).cast("string"), 2), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    line = _text(clock(e), ".250 --> ", clock(e + 1), ".500\n", K("event_type"), " & ", e, "\n\n")
    text = F.when(u % 3 == 2, line).otherwise(paragraph)
    whole = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", text.alias("t")))), lambda x: x["t"]), "").alias("t"))
    ttml = F.concat(F.lit("<tt>"), "t", F.lit("</tt>")).cast("binary")
    boxed = F.concat(F.unhex(F.lit("00000010")), F.lit("ftypisom----").cast("binary"), F.unhex(F.lpad(F.hex((F.octet_length(ttml) + 8).cast("long")), 8, "0")), F.lit("mdat").cast("binary"), ttml)
    data = F.when(u % 3 == 0, boxed).when(u % 3 == 1, ttml).otherwise(F.concat(F.lit("WEBVTT\n\n"), "t").cast("binary"))
    return subtitles.converted(whole.select(u.alias("id"), u.alias("track_id"), data.alias("data")), "srt")


def sample_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks behind sample entries of every layout, found by how their boxes tile."""
    k = K("s_suppkey")
    box = _boxed
    kid = F.upper(F.md5(k.cast("string").cast("binary")))
    tenc = box("tenc", F.concat(F.lit("00000000"), F.lit("0000"), F.lit("01"), F.lpad(F.hex((k % 2 * 8 + 8).cast("long")), 2, "0"), kid))
    sinf = box("sinf", F.concat(box("schm", F.lit("00000000" + b"cbcs".hex() + "00010000")), box("schi", tenc)))
    head = F.element_at(F.array(*[F.lit("00" * n) for n in binary.ENTRY_HEADS]), (k % 5 + 1).cast("int"))
    other = F.when(k % 4 == 0, box("btrt", F.lit("AB" * 12))).otherwise(F.lit(""))
    last = F.when(k % 7 == 6, F.lit("EE")).otherwise(F.lit(""))  # a byte too many: nothing tiles
    entry = F.when(k % 5 == 0, box("encv", F.concat(head, other, sinf, last))).otherwise(box("enca", F.concat(head, other, sinf, last)))
    stsd = box("stsd", F.concat(F.lit("0000000000000001"), entry))
    moov = box("moov", box("trak", box("mdia", box("minf", box("stbl", stsd)))))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.unhex(moov).alias("data"))
    return binary.protection(rows).select("id", "scheme", F.lower(F.hex("kid")).alias("kid"), "iv_size")


def cenc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of two samples around each part's name and type, with sizes, clear stretches, IVs and keys of their own, sealed by Spark and opened by what their boxes say."""
    k = K("p_partkey")
    size = lambda c: F.octet_length(c)
    hexed = lambda n, digits: F.lpad(F.hex(n.cast("long")), digits, "0")
    box = lambda kind, *load: _boxed(kind, F.concat(*load))
    p = table(spark, sf_dir, "part").select(k.alias("k"), K("p_name").cast("binary").alias("one"), _text(K("p_type"), " in ", K("p_brand")).cast("binary").alias("two"), (k % 7).cast("int").alias("c"), F.unhex(F.md5(k.cast("string").cast("binary"))).alias("key"))
    iv = lambda n: F.upper(F.substring(F.md5(_text(K("k"), f"/{n}").cast("binary")), 1, 16))
    p = p.withColumn("e1", F.floor((size("two") - K("c") - 1) / 2).cast("int"))
    cut = lambda c, at, n=None: F.substr(K(c), at + 1, F.lit(1 << 20) if n is None else n)
    first = cut("one", K("c"))
    second = F.concat(cut("two", K("c"), K("e1")), cut("two", K("c") + K("e1") + 1))

    def sealed(data: Column, n: int) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(size(data) / 16).cast("int") - 1), lambda i: F.concat(iv(n), hexed(i, 16)))
        return binary.xor_bytes(data, F.aes_encrypt(F.unhex(F.array_join(blocks, "")), "key", F.lit("ECB"), F.lit("PKCS")))

    p = p.withColumn("s1", sealed(first, 1)).withColumn("s2", sealed(second, 2))
    body = F.concat(cut("one", F.lit(0), K("c")), "s1", cut("two", F.lit(0), K("c")), cut("s2", F.lit(0), K("e1")), cut("two", K("c") + K("e1"), F.lit(1)), cut("s2", K("e1")))
    trun = box("trun", F.lit("00000201" "00000002" "0000007A"), hexed(size("one"), 8), hexed(size("two"), 8))
    senc = box("senc", F.lit("00000002" "00000002"), iv(1), F.lit("0001"), hexed(K("c"), 4), hexed(size("s1"), 8), iv(2), F.lit("0002"), hexed(K("c"), 4), hexed(K("e1"), 8), F.lit("0001"), hexed(size("s2") - K("e1"), 8))
    data = F.unhex(F.concat(box("moof", box("traf", box("tfhd", F.lit("0000000000000001")), trun, senc)), box("mdat", F.hex(body))))
    none = F.lit(None).cast("binary")
    pieces = p.select(K("k").alias("stream_id"), F.lit(False).alias("is_init"), data.alias("data"), none.alias("aes_key"), none.alias("iv"), F.lit(0).alias("seq"), K("key").alias("cenc_key"))
    tenc = box("tenc", F.lit("00000000" "0000" "01" "08"), F.hex("key"))
    entry = box("encv", F.lit("00" * 78), box("sinf", box("schm", F.lit("00000000" + b"cenc".hex() + "00010000")), box("schi", tenc)))
    moov = box("moov", box("trak", box("mdia", box("minf", box("stbl", box("stsd", F.lit("0000000000000001"), entry))))))
    clear = sink.transformed(pieces, p.select(K("k").alias("stream_id"), F.unhex(moov).alias("data")))
    return clear.select(K("stream_id").alias("p_partkey"), F.md5(F.substr("data", F.lit(123))).alias("md5"), (size("data") - 122).cast("long").alias("n_bytes"))


def _boxed(kind: str, load: Column) -> Column:
    """A box in hexadecimal."""
    return F.concat(F.lpad(F.hex((F.length(load) / 2 + 8).cast("long")), 8, "0"), F.lit(kind.encode().hex().upper()), load)


QUERIES = {
    f.__name__: f
    for f in (
        live_poll, commit_live_stream, commit_prefix_stream, stop_stream, ordered_files, live_files, streamed_files, downloads, fetched_keys, ts_cipher, ts_services, cc_segments, cc_stream,
        progress_text, job_logs, job_states, job_stops, selector_hits, dash_merged, dash_rejected, subtitle_files, sample_entries, cenc_samples,
    )
}

_PIECE = "event_id || ' ' || repeat(event_type, (event_id % 7)::INT) || chr(10)"
_FILE = f"SELECT 'user-' || user_id || '.ts' AS stream, sum(strlen({_PIECE}))::BIGINT AS n_bytes, md5(string_agg({_PIECE}, '' ORDER BY event_id)) AS md5"
_CC = """, a AS (SELECT *, afc IN (1, 3) AND pid <> 8191 AS counts FROM v_packets),
    b AS (SELECT *, CASE WHEN counts THEN (row_number() OVER (PARTITION BY stream, pid, counts ORDER BY segment, pkt_no) - 1) % 16 ELSE cc END AS n FROM a)
    SELECT stream, segment, string_agg(upper(to_hex(n)), '' ORDER BY pkt_no) AS counters FROM b GROUP BY ALL"""
_SIZE = "CASE WHEN {0} >= 1 << 30 THEN printf('%.2fGiB', {0} / (1 << 30)::DOUBLE) WHEN {0} >= 1 << 20 THEN printf('%.1fMiB', {0} / (1 << 20)::DOUBLE) WHEN {0} >= 1 << 10 THEN printf('%.0fKiB', {0} / 1024::DOUBLE) ELSE {0} || 'B' END"
_SECONDS = "CASE WHEN {0} >= 3600 THEN ({0} // 3600) || 'h' ELSE '' END || CASE WHEN {0} >= 60 THEN ({0} // 60 % 60) || 'm' ELSE '' END || ({0} % 60) || 's'"


def _views(sql: str, *names: str) -> str:
    return with_views(sql, *names).replace(") , ", "), ", 1)


ORACLE = {
    "live_poll": """
        WITH r AS (SELECT user_id::VARCHAR AS stream_id, 'https://ex.com/' || user_id || '/' || event_type || '-' || (event_id % 500) AS url, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        s AS (SELECT *, ceil(c * (n + 1) / 4.0) AS e FROM r, range(4) t(n)), shown AS (SELECT * FROM s WHERE i <= e AND i > e - ceil(c / 3.0)),
        backlog AS (SELECT DISTINCT stream_id, url FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY i DESC) AS newest FROM shown WHERE n = 0) WHERE newest > 3)
        SELECT DISTINCT stream_id, url FROM shown WHERE url NOT LIKE '%/error-%' AND NOT EXISTS (SELECT 1 FROM backlog b WHERE b.stream_id = shown.stream_id AND b.url = shown.url)""",
    "commit_live_stream": with_views("SELECT stream_id, idx FROM v_outcomes WHERE ok", "v_outcomes"),
    "commit_prefix_stream": _views(", s AS (SELECT stream_id, min(idx) AS stop FROM v_outcomes WHERE NOT ok GROUP BY 1) SELECT o.stream_id, o.idx FROM v_outcomes o LEFT JOIN s USING (stream_id) WHERE stop IS NULL OR o.idx < stop", "v_outcomes"),
    "stop_stream": """
        WITH a AS (SELECT user_id AS stream_id, event_id AS n, sum(event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id) >= 40 OR event_id % 97 = 3 OR event_id % 89 = 5 AS ended FROM events)
        SELECT stream_id, n, ended AS last FROM a QUALIFY NOT coalesce(bool_or(ended) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)""",
    "ordered_files": _FILE + ", count(*) AS next_idx, n_bytes AS \"offset\" FROM events GROUP BY user_id",
    "live_files": f"SELECT 'user-' || user_id || '.ts' AS stream, count(*) AS next_idx, coalesce(sum(strlen({_PIECE})) FILTER (NOT (event_type = 'error' AND value > 300)), 0)::BIGINT AS \"offset\" FROM events GROUP BY user_id",
    "streamed_files": _FILE.replace("sum(", "coalesce(sum(").replace(")::BIGINT", ") FILTER (ok), 0)::BIGINT").replace("ORDER BY event_id)", "ORDER BY event_id) FILTER (ok)") .replace("md5(string_agg", "md5(coalesce(string_agg").replace("FILTER (ok)) AS md5", "FILTER (ok), '')) AS md5") + " FROM (SELECT *, NOT (event_type = 'error' AND value > 300) AS ok FROM events) GROUP BY user_id",
    "downloads": _FILE + " FROM events GROUP BY user_id",
    "fetched_keys": """
        WITH a AS (SELECT o_orderkey AS id, o_custkey % 100 + 1 AS k, o_orderkey % 7 = 0 AS plain FROM orders), b AS (SELECT *, k <= (SELECT max(s_suppkey) FROM supplier) AND k % 5 <> 4 AS there FROM a)
        SELECT id, CASE WHEN plain OR there AND k % 3 = 0 THEN md5(k::VARCHAR) END AS key, CASE WHEN plain OR there AND k % 3 = 0 THEN '' WHEN there THEN 'key of 5 bytes' ELSE 'not fetched: status 0' END AS error FROM b""",
    "ts_cipher": "SELECT doc_id, 1 + strlen(coalesce(text, '')) AS n_bytes, md5('.' || coalesce(text, '')) AS md5 FROM documents",
    "ts_services": """
        WITH a AS (SELECT doc_id, regexp_replace(translate(upper(md5(doc_id::VARCHAR)[1:12]), '01234567', '89ABCDEF'), '(.)', 'F\\1', 'g') AS iv FROM documents)
        SELECT doc_id, 5::INT AS service, '' AS provider, 'mdcm|p|s|?' || iv || '00000000' AS name, iv || '00000000' AS iv FROM a""",
    "cc_segments": _views(_CC, "v_packets"),
    "cc_stream": _views(_CC, "v_packets"),
    "progress_text": _views(
        f""", a AS (SELECT stream_id AS k, count(*) FILTER (ok) AS done, count(*) AS total FROM v_outcomes GROUP BY 1),
        b AS (SELECT *, done * k * k * 37 AS bytes, k * 1000.0::DOUBLE + 0.25 AS speed, floor(k * 7.5 + 0.5)::BIGINT AS took FROM a),
        c AS (SELECT *, (bytes::DOUBLE / done) * (total - done) / speed AS eta, floor(speed)::BIGINT AS per FROM b)
        SELECT k AS stream_id, CASE WHEN k % 2 = 1 THEN 'REC ' || {_SECONDS.format('took')} || ' | ' || done || ' segs | ' || {_SIZE.format('bytes')} || ' | ' || {_SIZE.format('per')} || '/s'
            ELSE printf('%5.1f%%', done::DOUBLE / total * 100) || ' | ' || done || '/' || total || ' segs | ' || {_SIZE.format('bytes')} || ' | ' || {_SIZE.format('per')} || '/s | ETA '
                 || CASE WHEN speed > 1 AND total > done AND done > 8 AND eta < 360000 THEN {_SECONDS.format('floor(eta)::BIGINT')} ELSE '?' END END AS line FROM c""", "v_outcomes"),
    "job_logs": """
        WITH RECURSIVE w AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type || ' ' || event_id || CASE WHEN event_id % 3 = 0 THEN chr(10) || ' ' || event_id || '/9 segs | x ' || chr(10) ELSE chr(10) END AS t,
                CASE WHEN event_id % 3 = 0 THEN event_id || '/9 segs | x' END AS p FROM events),
        f AS (SELECT id, i, t AS log FROM w WHERE i = 1 UNION ALL SELECT w.id, w.i, CASE WHEN length(log || t) > 200 THEN right(log || t, 100) ELSE log || t END FROM f JOIN w ON w.id = f.id AND w.i = f.i + 1)
        SELECT id, arg_max(log, i) AS log, coalesce(any_value(p), '') AS progress FROM f JOIN (SELECT id, arg_max(p, i) FILTER (p IS NOT NULL) AS p FROM w GROUP BY 1) USING (id) GROUP BY id""",
    "job_states": """
        SELECT o_custkey AS id, arg_max(state, o_orderkey) AS state, arg_max(CASE WHEN state = 'error' THEN 'e' || o_orderkey ELSE '' END, o_orderkey) AS error, min(o_orderkey) AS started, max(o_orderkey) AS changed
        FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'error' END AS state FROM orders) GROUP BY 1""",
    "job_stops": with_views(
        """SELECT c_custkey AS request_id, c_custkey * 7 AS id, CASE WHEN state IS NULL THEN 'no such job' WHEN state <> 'running' THEN 'job not running' ELSE 'stopping' END AS answer, CASE WHEN state = 'running' THEN 'stopped' ELSE coalesce(state, '') END AS state
        FROM customer LEFT JOIN v_jobs j ON j.id = c_custkey * 7""", "v_jobs"),
    "selector_hits": _views(
        ", r AS (SELECT *, row_number() OVER (PARTITION BY manifest_id ORDER BY rank DESC) AS last FROM v_ranked WHERE media_type = 'video') "
        + " UNION ALL ".join(f"SELECT '{s}' AS selector, {'false' if w is None else 'true'} AS ok, count(*) FILTER ({w or 'false'}) AS hits FROM r" for s, w in SELECTORS.items()), "v_streams", "v_ranked"),
    "dash_merged": """
        WITH a AS (SELECT s_suppkey AS k, unnest(range(ceil((s_suppkey % 7 + 9) / 4.0)::BIGINT)) AS i FROM supplier)
        SELECT k AS manifest_id, i AS seg_ord, 'https://ex.com/lib/inner/one-' || CASE WHEN len((k + i)::VARCHAR) < 4 THEN lpad((k + i)::VARCHAR, 4, '0') ELSE (k + i)::VARCHAR END || '.m4s' AS url, 4.0::DOUBLE AS duration,
               CASE WHEN k % 3 = 0 THEN md5(k::VARCHAR) ELSE '00112233445566778899aabbccddeeff' END AS kid, 'https://ex.com/lib/outer/init.mp4' AS init_url FROM a""",
    "dash_rejected": """SELECT s_suppkey AS manifest_id, 'v' || s_suppkey || '.0.0' AS track, CASE WHEN s_suppkey % 2 = 0 THEN 'template without timeline and duration' ELSE 'no length of the period to count segments to' END AS reason
        FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0""",
    "subtitle_files": """
        WITH a AS (SELECT user_id, event_id, event_type || ' & ' || event_id AS text, min(event_id) OVER (PARTITION BY user_id) AS first, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        b AS (SELECT *, event_id - CASE WHEN first + 0.25 >= 3600 THEN first + 0.25 ELSE 0 END + 0.25 AS s FROM a),
        c AS (SELECT *, (s * 1000)::BIGINT AS x, (s * 1000 + 1250)::BIGINT AS y FROM b)
        SELECT user_id AS track_id, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', x // 3600000, x // 60000 % 60, x // 1000 % 60, x % 1000, y // 3600000, y // 60000 % 60, y // 1000 % 60, y % 1000)
               || chr(10) || text || chr(10) || chr(10), '' ORDER BY n) AS body FROM c GROUP BY 1""",
    "cenc_samples": "SELECT p_partkey, md5(p_name || p_type || ' in ' || p_brand) AS md5, strlen(p_name || p_type || ' in ' || p_brand) AS n_bytes FROM part",
    "sample_entries": "SELECT s_suppkey AS id, 'cbcs' AS scheme, md5(s_suppkey::VARCHAR) AS kid, (s_suppkey % 2 * 8 + 8)::INT AS iv_size FROM supplier WHERE s_suppkey % 7 <> 6",
}

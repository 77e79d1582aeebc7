"""Columns that are called like the operators' own pass through all of them."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import weirstream.llm
from weirstream.llm import chat, digest_index, langid, mixing, pieces, pii, queries, repeats, shards, url_filter
from weirstream.llm.common import staged

#: Every name with two underscores in the sources, and plain ones that operators have used.
PRIVATE = sorted({n for f in Path(weirstream.llm.__file__).parent.glob("*.py") for n in re.findall(r'"(__[a-z_]+)"', f.read_text())})
PLAIN = ["m", "k", "th", "n", "at", "digest", "copies", "positions", "tie", "bucket", "salt", "u", "x", "f", "c", "r", "_n", "_m", "_salt", "column0"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "The same text with words in it, and a thing that has been there", "en", "a"), (2, "The same text with words in it, and a thing that has been there", "en", "b"), (3, None, None, None), (None, "Ein anderer Text, der nicht derselbe ist und lang genug", "de", "a"), (4, "+1 555 123 4567 or jo at example dot com", "en", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = [F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(name) for name in [*PRIVATE, *PLAIN]]
    return frame.select("*", F.concat(F.lit("https://ex.com/"), "source").alias("url"), *extra)


def kept_whole(rows, added, dropped=()):
    """All extra columns are there with what they had."""
    assert set(rows[0].__fields__) >= set([*PRIVATE, *PLAIN]) - set(dropped) | set(added)
    for r in rows:
        for name in [*PRIVATE, *PLAIN]:
            if name not in dropped:
                assert r[name] == f"{name}:{'-' if r.doc_id is None else r.doc_id}", name


def test_there_are_names():
    assert len(PRIVATE) > 12


OPERATORS = {
    "language": (lambda s, d: langid.predict(d, langid.learn(d)), 5, ["lang_pred", "score"]),
    "copies": (lambda s, d: digest_index.drop_copies(d), 4, []),
    "order": (lambda s, d: mixing.training_order(d), None, []),
    "pieces": (lambda s, d: pieces.decoded(pieces.encoded(d, pieces.load(queries.default_model_file())), pieces.load(queries.default_model_file())), 5, ["ids", "n_bytes", "decoded"]),
    "repeats": (lambda s, d: repeats.without_repeats(d), 5, ["spans", "kept"]),
    "spans": (lambda s, d: pii.find(d, pii.fit(s, 400, rounds=1)), 5, ["base", "added"]),
    "urls": (lambda s, d: url_filter.judge(d, queries.URL_RULES, rounds=1), 5, ["host", "path", "rule", "score", "verdict"]),
    "shards": (lambda s, d: shards.external_shuffle(d, 3), 5, ["shard", "slot"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, clashing, name):
    run, n, added = OPERATORS[name]
    rows = run(spark, clashing).collect()
    assert rows and (n is None or len(rows) == n)
    kept_whole(rows, added)


def test_pipeline(spark, clashing):
    docs = clashing.drop("url")
    for stage, function in corpus_pipeline.STAGES:
        docs = staged(function(spark, docs, ""), stage)
        rows = docs.collect()
        assert rows
        kept_whole(rows, ["ids"] if stage == "sentencepiece" else [])


def test_private_names_as_arguments(spark):
    frame = spark.createDataFrame([(1, "a text"), (2, None)], "`__h` long, `__t` string")
    assert {r["__h"] for r in shards.external_shuffle(frame, 2, id_col="__h", text="__t").collect()} == {1, 2}
    assert {r["__h"]: r["lang_pred"] for r in langid.predict(frame, langid.learn(spark.createDataFrame([("a text", "en")], "text string, lang string")), "__t").collect()} == {1: "en", 2: "und"}
    assert {r["__h"]: bytes(r["kept"]) for r in repeats.without_repeats(frame, id_col="__h", text="__t").collect()} == {1: b"a text", 2: b""}


def test_read_back_of_clashing_columns(spark):
    log = chat.logged(spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn long, role string, text string"))
    rows = chat.read_back(chat.formatted(log).withColumn("cut", F.lit(1)).withColumn("cut_", F.lit(2))).collect()
    assert [(r.cut, r.cut_, r.messages[0].text) for r in rows] == [(1, 2, "hello")]

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weirstream.llm import chat, queries

TEXTS = ["a", "</s>", "<\\/s>", "[INST] x [/INST]", "<s>user\n", "<\\\\\\s>[\\INST][/INST]<", "日本😀", "\n\n", "", "<<s></s", "\\", "[[INST]", " [/INST]", "$1 %41", None]
LOG = "conv_id long, turn long, branch long, seq long, kind string, role string, text string, c string, r string"


def folded(events):
    """One event after the other."""
    place = {k: i for i, k in enumerate(chat.KINDS)}
    known = [e for e in events if e[4] in place and e[3] is not None]
    state = {}
    for conv, turn, branch, _, kind, role, text in sorted(known, key=lambda e: (e[3], place[e[4]], e[6] or "", e[5] or "")):
        key = (conv, turn, branch)
        message = state.setdefault(key, [None, ""])
        if kind == "begin":
            state[key] = [role or "", text or ""]
        elif kind == "edit":
            message[1] = text or ""
        elif kind == "delta":
            message[1] += text or ""
        elif kind == "delete":
            state[key] = [None, ""]
        else:
            message[1] = ""
            for other in state:
                if turn is not None and other[0] == conv and other[1] is not None and other[1] > turn:
                    state[other] = [None, ""]
    return sorted(((*k, *v) for k, v in state.items() if v[0] is not None), key=str)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    events = []
    for i in range(3000):
        conv = rng.choice([1, 2, 3, 4, None])
        turn = rng.randrange(300) if conv == 1 else rng.choice([*range(0, 90, 2), None])
        kind = rng.choices([*chat.KINDS, "x"], [8, 0.3, 2, 9, 0.3, 0.2])[0]
        seq = None if i % 97 == 0 else i // 2 if conv == 2 else i
        events += events[-1:] * (i % 50 == 1)
        events.append((conv, turn, rng.choice([0, 0, None]), seq, kind, rng.choice(["user", "assistant", None, "a b\n<s>"]), rng.choice(TEXTS)))
    return events, spark.createDataFrame([(*e, "x", "x") for e in events], LOG).repartition(5)


def test_fold_matches_one_event_after_the_other(spark, log):
    events, frame = log
    assert sorted(map(tuple, chat.fold(frame).collect()), key=str) == folded([e for e in events])
    assert chat.fold(frame.limit(0)).count() == 0 and chat.formatted(frame.limit(0)).count() == 0


def test_what_is_rendered_is_read_back(spark, log):
    events, frame = log
    want = {}
    for conv, turn, branch, role, text in folded(events):
        want.setdefault(conv, []).append(((turn is not None, turn or 0), role, text, (branch is not None, branch or 0)))
    rows = chat.read_back(chat.formatted(frame).withColumn("cut", F.lit(1))).collect()
    assert len(rows) == len(want)
    for r in rows:
        turns = [(role, text) for _, role, text, _ in sorted(want[r.conv_id])]
        assert [tuple(m) for m in r.messages] == turns and r.n_turns == len(turns) and r.cut == 1
        assert r.trained == [text for role, text in turns if role == "assistant"]
        masked = [re.sub(r"(?<=[<\[])\\(?=\\*(/?s>|/?INST\]))", "", r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        assert masked == r.trained
        assert r.formatted.count("</s>") == len(turns) and r.formatted.count("[INST]") == sum(role == "user" for role, _ in turns)


def test_escapes_come_back(spark):
    rng = random.Random(2)
    parts = ["<", ">", "s", "/", "[", "]", "INST", "\\", "</s>", "<s>", "[/INST]", "[INST]", "|", "$", "$end", "$\\end"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(800)] + ["<" + "\\" * 5000 + "/s>"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for template in (chat.Template(), chat.Template("<s>", "$end", (("user", "[INST]", ""),))):
        rows = frame.select("t", template.escaped(F.col("t")).alias("e")).withColumn("u", template.unescaped(F.col("e"))).collect()
        assert all(r.t == r.u and not any(c in r.e for c in template.controls) for r in rows)
    for bad in (("<", "</s>"), ("<s><s>", "</s>"), ("a", "bb"), ("<s\\>", "</s>")):
        with pytest.raises(ValueError):
            chat.Template(*bad)


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(6) if i % 9 else None, rng.randrange(40) if i % 11 else None, rng.choice(["user", "assistant", "system", None]), rng.choice(TEXTS) if i % 3 else "lang " * rng.randrange(300)) for i in range(300)]
    rows += [(7, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(500)] + [(7, 1, "assistant", "turn 1")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    by = {-1: [((True, 0), "user", "</s>[INST] ok [/INST]"), ((True, 1), "assistant", "</s>[INST] ok [/INST]")]}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        size = sum(len(f"<s>{role}\n</s>") + (15 if role == "user" else 0) + len(text) + len(re.findall(r"<\\*/?s>|\[\\*/?INST\]", text)) for _, role, text in turns)
        want[conv] = (len(turns), sha("".join(f"{role}\n{text}\n" for _, role, text in turns)), len(loss), sha(loss), size)
    assert {r[0]: tuple(r)[1:] for r in queries.op12_chat(spark, str(tmp_path)).collect()} == want


def test_query_without_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r.conv_id for r in queries.op12_chat(spark, str(tmp_path)).collect()] == [-1]


def test_a_log_of_rows_folds_to_them(spark):
    rows = [(1, 0, "user", "x" * 600), (1, 1, "assistant", "y" * 1000 + "😀"), (1, 1, "assistant", None), (None, None, None, "z"), (1, 2, "assistant", "")]
    log = chat.logged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 256)
    got = sorted([(m.conv_id, m.turn, m.role, m.text) for m in chat.fold(log).collect()], key=str)
    assert got == sorted([(c, t, r or "", x or "") for c, t, r, x in rows], key=str)
    assert log.filter("kind = 'delta'").count() == (4 + 1) + 1 + 1  # the first delta of each again

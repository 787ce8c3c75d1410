"""Each distinct text is embedded once, and each distinct message is answered once, whatever fails in between."""

import glob
import os
import sys
import time
import uuid

import numpy as np
import pytest
from conftest import plan
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passagework.functions.embedding import HashEmbedder
from passagework.operators.completion import FAILED, complete, complete_once, in_order
from passagework.operators.embed import embed, embed_distinct

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


class Counting(HashEmbedder):
    """Leaves a file with the lengths of each batch it is given."""

    def __init__(self, folder):
        super().__init__(16)
        self.folder = folder

    def encode(self, texts):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(f"{len(t)}:{t}" for t in texts))
        return super().encode(texts)


def seen(folder):
    return [open(f).read().split("\n") for f in glob.glob(f"{folder}/*")]


def test_a_provider_sees_each_text_once(spark, tmp_path):
    texts = [f"word{i % 37} " * (i % 11 + 1) for i in range(300)] + ["common text"] * 200 + [None, "", "  "]
    table = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, text string, embedding string").repartition(5)
    provider = Counting(str(tmp_path))
    for common in (4096, 2):
        got = embed_distinct(table, provider, batch_size=7, common=common)
        assert got.columns == ["i", "text", "embedding"]
        rows = {r.i: r.embedding for r in got.collect()}
        calls = [x for batch in seen(tmp_path) for x in batch]
        assert len(calls) == len(set(calls)) == len({t for t in texts if t and t.strip()})
        assert all(len(batch) <= 7 for batch in seen(tmp_path))
        for f in glob.glob(f"{tmp_path}/*"):
            os.unlink(f)
        want = {r.i: r.embedding for r in embed(table, HashEmbedder(16)).collect()}
        assert rows == want
    assert "CartesianProduct" not in plan(got) and "NestedLoop" not in plan(got)
    assert embed_distinct(table.limit(0), provider).count() == 0


def test_batches_have_texts_of_similar_length(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = [f"{i} " + "x" * int(n) for i, n in enumerate(rng.integers(1, 3000, 400))]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    embed_distinct(table, Counting(str(tmp_path)), batch_size=10).collect()
    spans = [max(n) - min(n) for n in ([int(x.split(":")[0]) for x in batch] for batch in seen(tmp_path))]
    assert np.median(spans) < 1500


MESSAGES = "i int, messages array<struct<role:string,content:string>>"


def asked(spark, n, distinct):
    return spark.createDataFrame([(i, [("user", f"question {i % distinct}")]) for i in range(n)] + [(n, None)], MESSAGES).repartition(3)


def model(folder, broken=()):
    def call(messages, temperature, limit):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(messages[0]["content"])
        if any(messages[0]["content"] == b for b in broken):
            raise RuntimeError("no answer")
        return f"re: {messages[0]['content']} {temperature} {limit}"

    return call


def test_equal_messages_are_answered_once_and_kept(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    first = complete_once(asked(spark, 60, 20), model(calls), answers, calls_at_once=6, concurrency=4, wait=0)
    rows = {r.i: r.answer for r in first.collect()}
    assert rows == {i: f"re: question {i % 20} 0.1 1024" for i in range(60)} | {60: None}
    assert len(seen(calls)) == 20
    # More rows: only what is new is asked.
    assert complete_once(asked(spark, 60, 25), model(calls), answers, wait=0).where("answer is not null").count() == 60
    assert len(seen(calls)) == 25
    assert complete_once(asked(spark, 60, 25), model(calls), answers, temperature=0.5, wait=0).count() == 61
    assert len(seen(calls)) == 50
    assert complete_once(asked(spark, 60, 25).limit(0), model(calls), str(tmp_path / "none")).count() == 0


def test_rounds_do_not_work_out_their_messages_again(spark, tmp_path):
    """However many rounds there are, messages are made once to be asked, and once where answers are joined to rows."""
    made = tmp_path / "made"
    made.mkdir()
    folder = str(made)

    @F.udf("array<struct<role:string,content:string>>")
    def make(i):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return [("user", f"question {i}")]

    rows = spark.range(0, 30, 1, 3).select("id", make.asNondeterministic()("id").alias("messages"))
    answered = complete_once(rows, model(tmp_path), str(tmp_path / "answers"), calls_at_once=3, wait=0)
    assert len(os.listdir(made)) == 30
    assert {r.id: r.answer for r in answered.select("id", "answer").collect()} == {i: f"re: question {i} 0.1 1024" for i in range(30)}


def test_a_job_that_dies_goes_on_after_its_last_round(spark, tmp_path):
    calls, answers, stop = tmp_path / "calls", str(tmp_path / "answers"), str(tmp_path / "stop")
    calls.mkdir()
    plain = model(calls)

    def dying(messages, temperature, limit):
        if len(os.listdir(calls)) >= 9:
            open(stop, "w").close()
            os._exit(1)  # the worker is gone, and with it what the round had
        return plain(messages, temperature, limit)

    with pytest.raises(Exception):
        complete_once(asked(spark, 40, 40).coalesce(1), dying, answers, calls_at_once=5, wait=0)
    assert os.path.exists(stop)
    kept = spark.read.parquet(answers).count()
    before = len(os.listdir(calls))
    assert 0 < kept <= before
    done = complete_once(asked(spark, 40, 40), plain, answers, calls_at_once=5, wait=0)
    assert done.where("answer is not null").count() == 40
    assert len(os.listdir(calls)) - before == 40 - kept  # nothing that was kept is asked again


def test_failures_are_repeated_and_asked_again_later(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    first = complete_once(asked(spark, 4, 4), model(calls, ["question 2"]), answers, retries=2, wait=0).collect()
    assert {r.i: r.answer for r in first}[2] == FAILED + "no answer" and len(seen(calls)) == 6
    again = complete_once(asked(spark, 4, 4), model(calls), answers, wait=0).collect()
    assert {r.i: r.answer for r in again}[2] == "re: question 2 0.1 1024" and len(seen(calls)) == 7


def test_calls_overlap_and_stay_in_order():
    under_way, most = [], []

    def slow(i):
        under_way.append(i)
        most.append(len(under_way))
        time.sleep(0.01 * (5 - i % 5))
        under_way.remove(i)
        return i

    assert list(in_order(slow, range(20), 4)) == list(range(20)) and 2 <= max(most) <= 4


def test_retries_of_the_column(spark, tmp_path):
    rows = asked(spark, 3, 3).select("i", complete(F.col("messages"), model(tmp_path, ["question 1"]), retries=1, wait=0, concurrency=3).alias("a"))
    got = {r.i: r.a for r in rows.collect()}
    assert got[1] == FAILED + "no answer" and got[3] is None and len(seen(tmp_path)) == 4

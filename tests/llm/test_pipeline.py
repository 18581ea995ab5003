"""The pipeline against plain versions of its stages."""

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from siglake.llm import tokens
from tests.llm import plain

R = random.Random(0)
SYLLABLES = {"aa": ["ba", "bo", "da", "do", "ka"], "zz": ["vul", "zyx", "wuv", "xil", "uzy"]}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [(k, prose(lang, R.randint(30, 700), k), lang) for k in range(60) for lang in [R.choice(["aa", "zz"])]]
    item = prose("aa", 40, 900)
    docs += [(100, docs[5][1], "aa"), (101, docs[5][1].upper(), "aa"), (102, "12 34 !!", "aa"), (103, None, "aa"), (104, "", None)]
    docs += [(105, prose("aa", 80, 901) + " " + item + " " + prose("aa", 50, 902), "aa"), (106, prose("zz", 60, 903) + ' token = "abcdef1234567890" ' + "0a" * 20 + prose("zz", 9, 904), "zz")]
    rows = [(k, t, lang, "s", len(t or ""), "clash") for k, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_id string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, columns = {r["doc_id"]: r["text"] for r in docs.collect()}, docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        if name == "language_id":
            want = {k: t for k, t in kept.items() if k not in (102, 103, 104)}
        elif name == "simhash_near_dedup":
            first = plain.components({k: plain.fingerprint(t) for k, t in kept.items()})
            want = {k: t for k, t in kept.items() if first[k] == k}
            assert not {100, 101} & set(want)
        elif name == "benchmark_decontamination":
            want = {k: t for k, t in kept.items() if k != 105}
        else:
            want = {}
            for k, t in kept.items():
                out, at = "", 0
                for a, _, b in plain.secrets(t):
                    out, at = (out + t[at:a] + "[SECRET]" if a >= at else out), max(at, b)
                want[k] = out + t[at:]
            assert want[106].count("[SECRET]") == 2
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert kept == want, name


def test_run_packs_what_is_kept(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer_path())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    ids = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids + [0] for r in docs.collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(ids) and sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    room = {}
    for r in got:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 2048


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_written_tables_can_be_dropped(spark):
    from siglake.llm.common import checkpointed, drop_written, shared_dir, written

    drop_written(spark)
    assert written(spark.range(3), "some").count() == 3
    found = lambda: list(Path(shared_dir(spark).removeprefix("file:")).glob("some-*"))
    kept = checkpointed(spark.range(4))
    file = Path(kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
    assert file.exists() and kept.count() == 4
    assert len(found()) == 1 and drop_written(spark) == 2 and not found() and not file.exists()


def test_queries_run_where_no_folder_is_configured():
    """In a process of its own, as the session here has its settings."""
    code = """
from pyspark.sql import SparkSession
from siglake.llm.queries import queries
from siglake.session import shared_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None) and shared_dir(spark) == shared_dir(spark)
for name in ("op4_token_counts", "op5_simhash"):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() == 200
spark.sparkContext.stop()
class Context:
    master, getCheckpointDir = "spark://host:7077", lambda self: None
class Cluster:
    sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, k, d: d})()
try:
    shared_dir(Cluster())
except ValueError as e:
    assert "spark.checkpoint.dir" in str(e)
else:
    raise AssertionError
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], env=os.environ | {"SPARK_CONF_DIR": "/nonexistent", "PYSPARK_SUBMIT_ARGS": "pyspark-shell"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

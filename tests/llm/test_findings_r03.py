"""What the findings of round 3 showed: shuffle files that stayed, and memory that stayed with the driver."""

import glob
import tracemalloc

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import common, quality


def test_settled_frames_leave_no_shuffle_files(spark):
    """Also where the frame was made before."""
    folder = spark.sparkContext.getConf().get("spark.local.dir")
    held = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    made = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    before = held()
    kept = common.settle(made)
    assert held() <= before
    assert dict(kept.collect()) == {k: sum(range(k, 5000, 7)) for k in range(7)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_large_heaps_are_collected():
    class Java:
        def __init__(self, total):
            self.total, self.collected = total, 0
            self.sparkContext = self._jvm = self.java = self.lang = self.Runtime = self.System = self

        def getRuntime(self):
            return self

        def totalMemory(self):
            return self.total

        def maxMemory(self):
            return 100

        def gc(self):
            self.collected += 1

    small, large = Java(50), Java(51)
    common.let_go(small)
    common.let_go(large)
    assert (small.collected, large.collected) == (0, 1)


def test_fit_holds_its_rows_in_few_bytes():
    """Three quarters are fitted: features of 4 bytes and values of 8 are 2.25 times what is given."""
    r = np.random.default_rng(1)
    rows = [np.unique(np.append(r.integers(100, 1 << 14, 1500), k // 4 % 2)).astype(np.int32) for k in range(600)]
    labels = np.arange(600) // 4 % 2
    tracemalloc.start()
    model = quality.fit(rows, labels, bits=14)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.75 * sum(x.nbytes for x in rows)
    effect = model.weight * model.scale
    assert effect[0] < 0 < effect[1]


def test_ids_stay_where_they_are_scored(spark):
    """The last shuffle of op2 sends scores, not the ids of the documents again."""
    from tessera.llm import lm
    from tessera.llm.queries import tokenizer_path

    docs = spark.createDataFrame([(k, "some words of a text") for k in range(20)], "doc_id long, text string")
    out = lm.score_documents(docs, tokenizer_path(), groups=4, members=8, least=1)
    sent = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x]
    assert len(sent) == 1 and "scores" in sent[0]
    assert out.count() == 20

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import neardup


def test_only_the_bitmap_is_broadcast(spark, monkeypatch):
    """Whatever their size on disk, tables whose rows grow with the documents' meet in shuffles."""
    plans: dict[str, list[str]] = {}
    write = neardup.staged

    def kept(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(neardup, "staged", kept)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[:-2] + ["y", "z"]), "another text of its own", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = neardup.near_duplicates(docs, words=2)
    assert {r.doc_id: r.component_id for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    plans["result"] = [out._jdf.queryExecution().executedPlan().toString()]
    found = {name: sum(p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin") for p in of) for name, of in plans.items()}
    assert {name for name, n in found.items() if n} <= {"candidate-texts"}
    assert len(found) > 8


def test_small_tables_take_few_files(spark, monkeypatch):
    """Each file costs an executor three processes on a local disk: links are not written in as many parts as a shuffle has."""
    files: dict[str, list[int]] = {}
    write = neardup.staged

    def kept(df, name):
        out = write(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup, "staged", kept)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in settings}
    texts = [" ".join(f"w{i}-{j}" for j in range(40)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *(t + " more" for t in texts)])), "doc_id long, text string").repartition(16)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=2).collect()} == {i: i % 60 for i in range(120)}
        # Only the first links of a run come without their number.
        assert sum(files["links"]) <= 16 + len(files["links"]) - 1
        assert len(files["confirmed"]) == 2 and max(files["confirmed"] + files["components"]) <= 16
        # What only one other table is made from is not written by itself.
        assert not files.keys() & {"candidates", "large-members"}

        files.clear()
        monkeypatch.setattr(neardup, "PART_LINKS", 8)
        path = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.range(101, 110).selectExpr("id - 1", "id")).repartition(16)
        got = [tuple(r) for r in neardup.components(path, 68).collect()]
        assert sorted(got) == [(i, 0) for i in range(60)] + [(i, 100) for i in range(100, 110)]
        assert 1 < max(files["links"]) <= 9
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)

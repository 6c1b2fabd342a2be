from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docmeter.functions import text as X
from docmeter.operators import boxes as B
from docmeter.plans import aggregate as A
from docmeter.plans import compare as C
from docmeter.sources import corpus
from docmeter.streaming import windows

RESULTS = "pipeline string, test_id string, product_type string, success boolean, error string, tags array<string>"


def values(spark, results, metrics):
    r = spark.createDataFrame(results, RESULTS)
    m = spark.createDataFrame(metrics, "pipeline string, test_id string, product_type string, metric string, value double, passed long, total long, cnt long")
    return {x["name"]: x["value"] for x in A.aggregate_metrics(m, r).collect()}


def ok(i, kind="parse"):
    return ("p", str(i), kind, True, None, [])


def bad(i, error, kind="parse"):
    return ("p", str(i), kind, False, error, [])


def test_failures_pad_and_skips_do_not(spark):
    m = [("p", "1", "parse", "s", 1.0, 8, 10, None), ("p", "2", "parse", "s", 0.5, 1, 10, None)]
    base = [ok(1), ok(2)]
    assert values(spark, base, m)["avg_s"] == 0.75
    v = values(spark, [*base, bad(3, "broke"), bad(4, "No layout data"), bad(5, "Worker error: x"), bad(6, "boom", "extract")], m)
    assert v["avg_s"] == 0.5 and v["min_s"] == 0 and v["max_s"] == 1 and v["micro_s"] == 0.45
    assert values(spark, [*base, bad(3, "Worker error: not LayoutOutput")], m)["avg_s"] == 0.5


def test_counts_and_values_beyond_one_are_not_padded(spark):
    m = [("p", "1", "parse", "c", 3.0, None, None, 3), ("p", "1", "parse", "big", 7.0, None, None, None)]
    v = values(spark, [ok(1), bad(2, "broke")], m)
    assert v["avg_c"] == 3 and v["total_c"] == 3 and v["avg_big"] == 7


def test_percentile_places(spark):
    got = A.stats(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double"), ["k"], "v").collect()[0]
    assert (got["p50"], got["p90"], got["p99"], got["n"], got["avg"]) == (3.0, 4.0, 4.0, 4, 2.5)


def test_normalize_in_catalyst_is_the_python_one(spark):
    texts = ["**Bold** and _it_  x", "Ä <b>é</b>—…", "a<sup>2</sup> b--c....", "<span x=1>q</span> “z” <http://a.b>", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize(F.col("t")).alias("n")).collect()
    assert all(r["n"] == X.normalize_py(r["t"]) for r in rows)


def test_compare(spark):
    a, b = (spark.createDataFrame(x, "test_id string, value double") for x in ([("1", 1.0), ("2", 0.0), ("3", 0.5), ("4", 1.0)], [("1", 0.5), ("2", 0.0), ("3", 0.5), ("5", 1.0)]))
    assert {r["test_id"]: r["category"] for r in C.compare(a, b).collect()} == {"1": "a_better", "2": "both_bad", "3": "tie", "4": "a_only", "5": "b_only"}


def test_greedy_and_ap(spark):
    gt = spark.createDataFrame([(1, 1, "A", 0.0, 0.0, 10.0, 10.0), (1, 2, "A", 20.0, 0.0, 30.0, 10.0)], "page int, gt_id int, cls string, x0 double, y0 double, x1 double, y1 double")
    pred = spark.createDataFrame([(1, 1, "A", 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, "A", 0.8, 1.0, 0.0, 10.0, 10.0), (1, 3, "A", 0.7, 20.0, 0.0, 30.0, 10.0)], "page int, pred_id int, cls string, score double, x0 double, y0 double, x1 double, y1 double")
    pairs = B.overlaps(gt, pred, ["page"])
    assert {(r["gt_id"], r["pred_id"]) for r in B.greedy(pairs, ["page"]).collect()} == {(1, 1), (2, 3)}
    ap = B.mean_ap(gt, pred, pairs, ["page"]).where("threshold = 0.5").collect()[0]["ap"]
    assert ap == pytest.approx((1 + 2 / 3) / 2)


def test_union_area():
    assert B.union_area([(0, 0, 2, 2), (1, 1, 3, 3)]) == 7 and B.union_area([]) == 0


def test_rules_and_predictions(spark, tmp_path):
    (tmp_path / "table.jsonl").write_text('{"pdf": "a.pdf", "id": "2", "type": "present", "tags": ["x"], "rule": "{\\"text\\": \\"q\\"}"}\n{"pdf": "a.pdf", "id": "1", "type": "expected_markdown", "expected_markdown": "md", "tags": ["y"]}\n')
    g = corpus.group_rules(corpus.read_rules(spark, str(tmp_path))).collect()
    assert len(g) == 1 and g[0]["test_id"] == "table/a.pdf" and g[0]["expected_markdown"] == "md" and g[0]["tags"] == ["x", "y"] and g[0]["rules"][0]["id"] == "1"
    assert "docs" in corpus.ready(spark, str(tmp_path)) and "table.jsonl" not in corpus.ready(spark, str(tmp_path))
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.result.json").write_text('{"pipeline_name": "p", "output": {"example_id": "a", "markdown": "hi"}}')
    (tmp_path / "p/b.result.json").write_text("{broken")
    rows = corpus.read_predictions(spark, str(tmp_path / "p")).cache().collect()
    assert len(rows) == 2 and sum(r["_corrupt_record"] is not None for r in rows) == 1
    assert corpus.skip_rows(["a,,", ",", "x,y"]) == 2


def test_match_by_form(spark):
    cases = spark.createDataFrame([("café",), ("b",)], "test_id string")
    p = spark.createDataFrame([("café",), ("b.pdf",), ("zz",)], "example_id string")
    assert {(r["example_id"], r["test_id"]) for r in corpus.match(cases, p).collect()} == {("café", "café"), ("b.pdf", "b")}


def test_stream_gives_the_batch_windows(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.stream(spark, str(tmp_path / "in"), batch.schema, late="40 days"))
    q = s.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r["start"]), r["event_type"], r["n"]) for r in spark.table("w").collect()}
    assert got == {(str(r["start"]), r["event_type"], r["n"]) for r in windows.tumbling(batch, "1 day").collect()}
    assert windows.sessions(batch.withColumn("ts", F.col("ts").cast("timestamp"))).count() > 0


def test_upsert_keeps_the_newest(spark, tmp_path):
    rows = spark.createDataFrame([("p", "1", 1, 0.5), ("p", "1", 2, 0.7), ("p", "2", 1, 0.1)], "pipeline string, test_id string, completed_at int, value double")
    rows.write.parquet(str(tmp_path / "in"))
    windows.upsert(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r["test_id"], r["value"]) for r in windows.newest(spark, str(tmp_path / "out")).collect()} == {("1", 0.7), ("2", 0.1)}


def test_normalise_text_reads_whole_texts(spark, tmp_path):
    from docmeter.plans import catalog

    catalog.load()
    spark.createDataFrame([(1, "word " * 100 + "end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["normalise_text"](spark, str(tmp_path)).collect()[0]["cell"].endswith("end")


def test_eval_results_are_read_once(spark):
    """All pass rates come of one pass over the rule results, with tests without rules and results without tests."""
    from docmeter.operators import evaluate as E

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(1, "a", True, 1.0), (1, "a", False, 0.5), (1, "b", True, 1.0), (9, "z", False, 0.0)]
    r = spark.createDataFrame(rows, "test_id long, type string, passed boolean, score double").mapInArrow(count, "test_id long, type string, passed boolean, score double")
    got = {tuple(x) for x in E.document_metrics(r, spark.createDataFrame([(1,), (1,), (2,)], "test_id long")).collect()}
    assert got == {(1, "rule_pass_rate", 2.5 / 3, 2, 3), (1, "rule_a_pass_rate", 0.75, 1, 2), (1, "rule_b_pass_rate", 1.0, 1, 1), (2, "rule_pass_rate", 1.0, 0, 0), (9, "rule_z_pass_rate", 0.0, 0, 1)}
    assert seen.value == len(rows)


def test_pages_count_tokens_in_a_table(monkeypatch):
    """A page's tokens are counted as rows of one table; pages too large for one give the same scores by Counters."""
    import random

    import pyarrow as pa

    from docmeter.operators import layout as L

    rng = random.Random(3)

    def page(n: int) -> tuple[L.Part, L.Part, list[pa.Array]]:
        parts = L.Part(), L.Part()
        for p in parts:
            for i in range(n):
                y = rng.randrange(5)
                p.id.append(i)
                p.cls.append(rng.choice("ab"))
                p.rank.append(i)
                p.box.append((0.0, 10.0 * y, 100.0, 10.0 * y + rng.choice([10, 20])))
                p.marks.append((rng.random() < 0.3, rng.random() < 0.1, rng.random() < 0.3))
        return *parts, [pa.array(rng.choices([*"uvwxyz", None], k=rng.randrange(12)), pa.string()) for _ in range(2 * n)]

    for n in [0, 1, 3, 6] * 10:
        gt, pred, texts = page(n)
        out = []
        for most, kind in ((16_000_000, L.Bag), (0, L.Counter)):
            monkeypatch.setattr(L, "DENSE", most)
            bags = L.bags_of(texts)
            assert not any(map(len, texts)) or all(isinstance(b, kind) for b in bags)
            gt.tokens, pred.tokens = bags[:n], bags[n:]
            out.append([f(gt, pred) for f in (L.score_elements, L.score_page, L.score_classes)])
        assert out[0] == out[1]


def test_pairs_that_stand_alone_take_no_turns(spark):
    """Greedy matches of random pages against a plain loop, in batches that cut pages; pages of pairs that stand alone are matched as arrays."""
    import random
    import pyarrow as pa

    from docmeter.operators import boxes as B

    rng = random.Random(5)
    rows = [(p, rng.randrange(size), rng.randrange(size), c, c, rng.randrange(4) / 4, rng.randrange(10, 21) / 20) for p in range(60) for size in (rng.choice([2, 5, 40]),) for c in "ab" for _ in range(size)]
    pairs = spark.createDataFrame(rows, "page long, gt_id long, pred_id long, g_cls string, p_cls string, score double, iou double").distinct()
    want = set()
    for t in (0.5, 0.7, 0.9):
        seen = set()
        for r in sorted(set(rows), key=lambda r: (r[0], r[3], -r[5], r[2], -r[6], r[1])):
            g, p = ("g", r[0], r[3], r[1]), ("p", r[0], r[3], r[2])
            if r[6] >= t and not {g, p} & seen:
                seen |= {g, p}
                want.add((t, *r))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = B.greedy_all(pairs, ["page"], (0.5, 0.7, 0.9)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    batch = pa.RecordBatch.from_pydict({"page": [1, 1, 2, 2], "cls": ["a", "b", "b", "b"]})
    assert B.groups(batch, [0, 1]).tolist() == [0, 1, 2, 2]


def test_areas_are_read_without_tokens(spark):
    """Only boxes are shuffled for the areas of a page; pages of one side, too, have a row."""
    from docmeter.operators import layout as L

    kind = "page long, id long, cls string, x0 double, y0 double, x1 double, y1 double"
    gt = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 2, "a", 5.0, 0.0, 15.0, 10.0), (2, 1, "a", 0.0, 0.0, 1.0, 1.0)], kind)
    pred = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 15.0, 5.0), (3, 1, "a", 0.0, 0.0, 1.0, 1.0)], kind)
    out = L.set_iou(gt, pred, ["page"])
    assert {tuple(r) for r in out.collect()} == {(1, 0.5, 0.5), (2, 0.0, 0.0), (3, 0.0, 0.0)}
    assert "tokens" not in out._jdf.queryExecution().analyzed().toString()


def test_records_are_paired_in_one_stream(spark):
    """Greedy pairs of records without a data frame for each document; ties by rank."""
    from docmeter.operators import grounding as G

    kind = "k long, rank long, a string, b string, c string"
    left = [(k, r, f"a{r % 2}", f"b{r}", "c") for k in range(30) for r in range(4)]
    right = [(k, r, f"a{r % 2}", f"b{r % 3}", "c") for k in range(30) for r in range(5)]
    out = G.aligned_records(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), "k", ["a", "b", "c"])
    want = set()
    for k in range(30):
        near = sorted((-sum(x == y for x, y in zip(p[2:], q[2:], strict=True)), p[1], q[1]) for p in left for q in right if p[0] == q[0] == k)
        used: set = set()
        for n, p, q in near:
            if n <= -2 and not {("l", p), ("r", q)} & used:
                used |= {("l", p), ("r", q)}
                want.add((k, p, q, round(-n / 3, 9)))
    assert {(r["k"], r["rank"], r["other"], round(r["agree"], 9)) for r in out.collect()} == want
    assert "InPandas" not in out._jdf.queryExecution().analyzed().toString()


def test_a_field_is_sent_only_units_inside_its_boxes(spark, monkeypatch):
    """Units of a document that stand outside a field's boxes stay in Spark; the ones inside decide as before, and a field without boxes has none."""
    from docmeter.operators import grounding as G

    kind = "test_id long, field_path string, expected string, kind string, boxes array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"
    rules = spark.createDataFrame([(1, "a", "7", "number", [(1, 0.0, 0.0, 10.0, 10.0)]), (1, "b", "8", "number", None)], kind)
    units = spark.createDataFrame([(1, "word", 1, "7", 1, 0.0, 0.0, 10.0, 10.0), (1, "word", 2, "9", 1, 6.0, 0.0, 16.0, 10.0), (1, "word", 3, "5", 2, 0.0, 0.0, 10.0, 10.0)], "test_id long, granularity string, rank int, text string, page int, x0 double, y0 double, x1 double, y1 double")
    out = G.field_rules(rules, units)
    assert {(r["field_path"], r["iou"], r["score"], r["found"], r["element"]) for r in out.collect()} == {("a", 1.0, 1.0, "7", True), ("b", 0.0, 0.0, "", False)}
    assert "filter(units" in out._jdf.queryExecution().analyzed().toString() and "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()

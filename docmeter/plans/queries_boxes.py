"""Queries over boxes, made from line items: a page is an order, a class a return flag, the prediction a shifted box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import grounding as G
from ..operators import layout as L
from .catalog import query, read

GT_SQL = "SELECT l_orderkey AS page, (l_partkey * 1000 + l_suppkey) * 8 + l_linenumber AS gt_id, l_returnflag AS cls, (l_partkey % 8) * 16.0 AS x0, (l_suppkey % 8) * 16.0 AS y0, (l_partkey % 8) * 16.0 + 32 + l_linenumber AS x1, (l_suppkey % 8) * 16.0 + 32 AS y1 FROM lineitem WHERE l_linenumber <= 7"
PRED_SQL = "SELECT l_orderkey AS page, (l_partkey * 1000 + l_suppkey) * 8 + l_linenumber AS pred_id, CASE WHEN l_partkey % 9 = 0 THEN 'A' ELSE l_returnflag END AS cls, (l_partkey % 17 + 1) / 32.0 + l_linenumber / 1024.0 AS score, (l_partkey % 8) * 16.0 + l_partkey % 5 * 2 AS x0, (l_suppkey % 8) * 16.0 + l_suppkey % 3 * 3 AS y0, (l_partkey % 8) * 16.0 + l_partkey % 5 * 2 + 32 AS x1, (l_suppkey % 8) * 16.0 + l_suppkey % 3 * 3 + 33 AS y1 FROM lineitem WHERE l_linenumber <= 7 AND l_partkey % 11 <> 0"
PAIRS_SQL = f"""o AS (SELECT page, gt_id, pred_id, g.cls AS g_cls, p.cls AS p_cls, score, (least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS inter, (g.x1 - g.x0) * (g.y1 - g.y0) AS ga, (p.x1 - p.x0) * (p.y1 - p.y0) AS pa,
    g.y0 AS gy0, g.y1 AS gy1, g.x0 AS gx0, g.x1 AS gx1, p.y0 AS py0, p.y1 AS py1, p.x0 AS px0, p.x1 AS px1
    FROM ({GT_SQL}) g JOIN ({PRED_SQL}) p USING (page) WHERE g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1), i AS (SELECT *, inter::DOUBLE / (ga + pa - inter)::DOUBLE AS iou, inter::DOUBLE / ga::DOUBLE AS ioa_gt, inter::DOUBLE / pa::DOUBLE AS ioa_pred FROM o)"""


def pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gt, pred)."""
    li = read(spark, sf_dir, "lineitem").where("l_linenumber <= 7")
    d = lambda c: c.cast("double")
    x, y = d(F.col("l_partkey") % 8 * 16), d(F.col("l_suppkey") % 8 * 16)
    ident = (F.col("l_partkey") * 1000 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")
    gt = li.select(F.col("l_orderkey").alias("page"), ident.alias("gt_id"), F.col("l_returnflag").alias("cls"), x.alias("x0"), y.alias("y0"), (x + 32 + F.col("l_linenumber")).alias("x1"), (y + 32).alias("y1"))
    px, py = x + F.col("l_partkey") % 5 * 2, y + F.col("l_suppkey") % 3 * 3
    cls = F.when(F.col("l_partkey") % 9 == 0, "A").otherwise(F.col("l_returnflag"))
    score = (F.col("l_partkey") % 17 + 1) / 32 + F.col("l_linenumber") / 1024
    pred = li.where("l_partkey % 11 <> 0").select(F.col("l_orderkey").alias("page"), ident.alias("pred_id"), cls.alias("cls"), score.alias("score"), px.alias("x0"), py.alias("y0"), (px + 32).alias("x1"), (py + 33).alias("y1"))
    return gt, pred


def paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    gt, pred = pages(spark, sf_dir)
    return gt, pred, B.overlaps(gt, pred, ["page"])


@query(f"WITH {PAIRS_SQL} SELECT page, gt_id, pred_id, round(iou, 9) AS iou, round(ioa_gt, 9) AS ioa_gt, round(ioa_pred, 9) AS ioa_pred FROM i")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir)[2].select("page", "gt_id", "pred_id", *(F.round(c, 9).alias(c) for c in ("iou", "ioa_gt", "ioa_pred")))


BEST_SQL = f"WITH {PAIRS_SQL}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, gt_id ORDER BY iou DESC, pred_id) AS r FROM i WHERE ioa_gt >= 0.5 AND ioa_pred >= 0.2) WHERE r = 1)"


@query(f"{BEST_SQL} SELECT g.page, g.gt_id, g.cls, pred_id, p_cls, pred_id IS NOT NULL AS localised, coalesce(g.cls = p_cls, false) AS classified FROM ({GT_SQL}) g LEFT JOIN b ON g.page = b.page AND g.gt_id = b.gt_id")
def layout_localisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, _, pairs = paired(spark, sf_dir)
    return B.layout_rules(gt, B.best_match(pairs, ["page"]), ["page"])


@query(f"{BEST_SQL} SELECT g.cls, avg((pred_id IS NOT NULL)::INT)::DOUBLE AS localised, avg(coalesce(g.cls = p_cls, false)::INT)::DOUBLE AS classified, avg((pred_id IS NOT NULL AND g.cls = p_cls)::INT)::DOUBLE AS element FROM ({GT_SQL}) g LEFT JOIN b ON g.page = b.page AND g.gt_id = b.gt_id GROUP BY 1")
def layout_element_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = layout_localisation(spark, sf_dir)
    return r.groupBy("cls").agg(*(F.avg(c.cast("double")).alias(n) for n, c in (("localised", F.col("localised")), ("classified", F.col("classified")), ("element", F.col("localised") & F.col("classified")))))


# Boxes of a page stand apart from each other, each in its own place; a prediction is missing, of another class, smaller, or right.
APART_SQL = """r AS (SELECT l_orderkey AS page, l_returnflag AS cls, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS id FROM lineitem),
    m AS (SELECT page, id, cls, k, CASE WHEN k % 5 = 0 THEN 'A' ELSE cls END AS p_cls, (k % 64) / 64.0::DOUBLE AS score, CASE k % 4 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE 1.0 END AS iou, k % 7 <> 0 AS there FROM r)"""


def apart(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = read(spark, sf_dir, "lineitem")
    k, i = F.col("k"), F.col("id")
    rows = li.select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("cls"), F.col("l_partkey").alias("k"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long").alias("id"))
    box = lambda h: [F.lit(0.0).alias("x0"), (20.0 * i).alias("y0"), F.lit(100.0).alias("x1"), (20.0 * i + h).alias("y1")]
    gt = rows.select("page", i.alias("gt_id"), "cls", *box(F.lit(10.0)))
    high = F.when(k % 4 == 1, 6.0).when(k % 4 == 2, 8.0).otherwise(10.0)
    pred = rows.where(k % 7 != 0).select("page", i.alias("pred_id"), F.when(k % 5 == 0, "A").otherwise(F.col("cls")).alias("cls"), (k % 64 / 64).alias("score"), *box(high))
    return gt, pred, B.overlaps(gt, pred, ["page"])


@query(f"""WITH {APART_SQL}, n AS (SELECT cls, count(*) AS support, count(CASE WHEN there AND p_cls = cls THEN 1 END) AS tp FROM m GROUP BY 1), p AS (SELECT p_cls AS cls, count(*) AS preds FROM m WHERE there GROUP BY 1)
    SELECT n.cls, support, tp, coalesce(preds, 0) - tp AS fp, support - tp AS fn, round(coalesce(tp / nullif(preds, 0), 0)::DOUBLE, 9) AS precision, round((tp / support)::DOUBLE, 9) AS recall, round(coalesce(2 * tp / nullif(preds + support, 0), 0)::DOUBLE, 9) AS f1 FROM n LEFT JOIN p ON p.cls = n.cls""")
def detection_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, pairs = apart(spark, sf_dir)
    out = B.class_scores(gt, pred, B.greedy(pairs, ["page"]), ["page"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"""WITH {APART_SQL}, t AS (SELECT unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]) AS t), s AS (SELECT t, p_cls AS cls, score, count(*) AS n, count(CASE WHEN p_cls = cls AND iou >= t / 100.0 THEN 1 END) AS h FROM m, t WHERE there GROUP BY ALL),
    w AS (SELECT *, sum(h) OVER (PARTITION BY t, cls ORDER BY score DESC) / sum(n) OVER (PARTITION BY t, cls ORDER BY score DESC) AS prec FROM s), g AS (SELECT DISTINCT cls FROM m),
    a AS (SELECT t.t, g.cls, coalesce((SELECT sum(prec * h) / nullif(sum(h), 0) FROM w WHERE w.t = t.t AND w.cls = g.cls), 0) AS ap FROM g, t)
    SELECT round(avg(ap)::DOUBLE, 9) AS map, round(avg(CASE WHEN t = 50 THEN ap END)::DOUBLE, 9) AS ap50, round(avg(CASE WHEN t = 75 THEN ap END)::DOUBLE, 9) AS ap75 FROM a""")
def detection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, pairs = apart(spark, sf_dir)
    ap = lambda t: F.avg(F.when(F.col("threshold") == t, F.col("ap")))
    return B.mean_ap(gt, pred, pairs, ["page"]).groupBy().agg(F.round(F.avg("ap"), 9).alias("map"), F.round(ap(0.5), 9).alias("ap50"), F.round(ap(0.75), 9).alias("ap75"))


@query(f"""WITH {APART_SQL}, c AS (SELECT cls AS g_cls, CASE WHEN there THEN p_cls ELSE '(none)' END AS p_cls, count(*) AS n FROM m GROUP BY ALL) SELECT g_cls, p_cls, n, round(100 * n / sum(n) OVER (PARTITION BY g_cls)::DOUBLE, 9) AS percent FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred, pairs = apart(spark, sf_dir)
    return B.confusion(gt, pred, B.greedy(pairs, ["page"], any_class=True), ["page"]).withColumn("percent", F.round("percent", 9))


@query(f"""WITH {PAIRS_SQL}, own AS (SELECT page, gt_id, gx0, gx1, gy0, gy1, greatest(gx0, px0) AS cx0, least(gx1, px1) AS cx1, greatest(gy0, py0) AS cy0, least(gy1, py1) AS cy1 FROM i WHERE ioa_pred >= 0.2),
    u AS (SELECT *, max(cy1) OVER (PARTITION BY page, gt_id ORDER BY cy0, cy1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM own),
    s AS (SELECT page, gt_id, least((max(cx1) - min(cx0)) / max(gx1 - gx0), 1) AS x_span, least(sum(greatest(cy1 - greatest(coalesce(top, cy0), cy0), 0)) / max(gy1 - gy0), 1) AS y_cover FROM u GROUP BY 1, 2)
    SELECT g.page, g.gt_id, round(coalesce(x_span, 0)::DOUBLE, 9) AS x_span, round(coalesce(y_cover, 0)::DOUBLE, 9) AS y_cover, coalesce(x_span >= 0.8 AND y_cover >= 0.5, false) AS localised FROM ({GT_SQL}) g LEFT JOIN s ON g.page = s.page AND g.gt_id = s.gt_id""")
def furniture_band_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, _, pairs = paired(spark, sf_dir)
    return B.band_cover(gt, pairs, ["page"]).withColumns({c: F.round(c, 9) for c in ("x_span", "y_cover")})


@query(f"""WITH g AS ({GT_SQL}), w AS (SELECT page, x0, x1, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g)
    SELECT page, sum(greatest(x1 - greatest(coalesce(top, x0), x0), 0))::DOUBLE AS length FROM w GROUP BY 1""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.union_length(pages(spark, sf_dir)[0], ["page"], "x0", "x1")


ORDER_SQL = "SELECT conv_id, turn AS ro_index, turn AS element, (turn + turn * turn * conv_id) % 7 AS pred_order FROM conversations"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", t.alias("ro_index"), t.alias("element"), ((t + t * t * F.col("conv_id")) % 7).alias("pred_order"))


@query(f"""WITH o AS ({ORDER_SQL}), w AS (SELECT *, max(pred_order) OVER (PARTITION BY conv_id ORDER BY ro_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, min(pred_order) OVER (PARTITION BY conv_id ORDER BY ro_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM o)
    SELECT conv_id, ro_index, element, pred_order, coalesce(b < pred_order, true) AND coalesce(a > pred_order, true) AND (a IS NOT NULL OR b IS NOT NULL) AS passed FROM w""")
def reading_order_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.local_order(turns(spark, sf_dir), ["conv_id"])


@query(f"""WITH o AS ({ORDER_SQL}), l AS (SELECT *, lead(pred_order) OVER (PARTITION BY conv_id ORDER BY ro_index) AS nxt FROM o),
    a AS (SELECT conv_id, coalesce(avg(CASE WHEN nxt IS NOT NULL THEN (pred_order <= nxt)::INT END), 1)::DOUBLE AS adjacent FROM l GROUP BY 1),
    p AS (SELECT x.conv_id, avg((x.pred_order <= y.pred_order)::INT)::DOUBLE AS pairwise FROM o x JOIN o y ON x.conv_id = y.conv_id AND x.ro_index < y.ro_index GROUP BY 1)
    SELECT a.conv_id, round(adjacent, 9) AS adjacent, round(coalesce(pairwise, 1.0), 9) AS pairwise FROM a LEFT JOIN p ON a.conv_id = p.conv_id""")
def reading_order_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.order_accuracy(turns(spark, sf_dir), ["conv_id"]).withColumns({c: F.round(c, 9) for c in ("adjacent", "pairwise")})


# A page is four documents, one below the other; each prediction reaches over the next one, too, and lacks every seventh token. So the
# second and third document meet two predictions that fit equally well, of which the first counts.
TOKENS_SQL = """g AS (SELECT doc_id // 4 AS page, doc_id AS gt_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents), p AS (SELECT doc_id // 4 AS page, doc_id AS pred_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x, i: i % 7 <> 0) AS tokens FROM documents),
    l AS (SELECT g.page, gt_id, pred_id FROM g JOIN p ON g.page = p.page AND (gt_id = pred_id OR gt_id = pred_id + 1)),
    gt AS (SELECT page, gt_id, token, count(*) AS n FROM (SELECT page, gt_id, unnest(tokens) AS token FROM g) GROUP BY ALL), pt AS (SELECT page, pred_id, token, count(*) AS n FROM (SELECT page, pred_id, unnest(tokens) AS token FROM p) GROUP BY ALL)"""


def token_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents")
    i, k = F.col("doc_id"), (F.col("doc_id") % 4).cast("double")
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    own = d.select(F.floor(i / 4).alias("page"), i.alias("id"), F.lit(0.0).alias("x0"), (10 * k).alias("y0"), F.lit(100.0).alias("x1"), k.alias("k"), F.col("lang"), tokens.alias("tokens"))
    g = own.select("page", "id", F.col("lang").alias("cls"), "x0", "y0", "x1", (10 * F.col("k") + 10).alias("y1"), "tokens")
    p = own.select("page", "id", F.when(F.col("id") % 5 == 0, "none").otherwise(F.col("lang")).alias("cls"), "x0", "y0", "x1", F.when(F.col("k") == 3, 40.0).otherwise(10 * F.col("k") + 20).alias("y1"), F.filter("tokens", lambda x, j: (j + 1) % 7 != 0).alias("tokens"))
    return g, p


@query(f"""WITH {TOKENS_SQL},
    a AS (SELECT pt.page, sum(least(pt.n, coalesce(m, 0))) / sum(pt.n) AS lap FROM pt LEFT JOIN (SELECT l.page, pred_id, token, sum(n) AS m FROM l JOIN gt ON l.page = gt.page AND l.gt_id = gt.gt_id GROUP BY ALL) x ON pt.page = x.page AND pt.pred_id = x.pred_id AND pt.token = x.token GROUP BY 1),
    b AS (SELECT gt.page, sum(least(gt.n, coalesce(m, 0))) / sum(gt.n) AS lar FROM gt LEFT JOIN (SELECT l.page, gt_id, token, sum(n) AS m FROM l JOIN pt ON l.page = pt.page AND l.pred_id = pt.pred_id GROUP BY ALL) x ON gt.page = x.page AND gt.gt_id = x.gt_id AND gt.token = x.token GROUP BY 1),
    q AS (SELECT DISTINCT page FROM g), e AS (SELECT q.page, coalesce(lap, 1) AS lap, coalesce(lar, 1) AS lar FROM q LEFT JOIN a ON q.page = a.page LEFT JOIN b ON q.page = b.page)
    SELECT page, round(lap::DOUBLE, 9) AS lap, round(lar::DOUBLE, 9) AS lar, round((CASE WHEN lap + lar > 0 THEN 2 * lap * lar / (lap + lar) ELSE 0 END)::DOUBLE, 9) AS af1 FROM e""")
def lap_lar_af1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_scores(*token_pages(spark, sf_dir), ["page"]).select("page", *(F.round(c, 9).alias(c) for c in ("lap", "lar", "af1")))


@query(f"""WITH {TOKENS_SQL}, r AS (SELECT gt.page, gt.gt_id, sum(least(gt.n, coalesce(m, 0))) / sum(gt.n) AS recall FROM gt LEFT JOIN (SELECT l.page, gt_id, token, sum(n) AS m FROM l JOIN pt ON l.page = pt.page AND l.pred_id = pt.pred_id GROUP BY ALL) x ON gt.page = x.page AND gt.gt_id = x.gt_id AND gt.token = x.token GROUP BY 1, 2),
    q AS (SELECT DISTINCT page FROM g) SELECT q.page, round(coalesce(avg((recall >= 0.8)::INT), 1)::DOUBLE, 9) AS accuracy FROM q LEFT JOIN r ON q.page = r.page GROUP BY 1""")
def grounding_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_scores(*token_pages(spark, sf_dir), ["page"]).select("page", F.round("grounding", 9).alias("accuracy"))


# Of a pair of element and prediction: tokens that only the other element under the prediction has are taken off the prediction.
ELEMENTS_SQL = f"""{TOKENS_SQL},
    pair AS (SELECT l.page, l.gt_id, l.pred_id, o.gt_id AS other FROM l LEFT JOIN l o ON o.pred_id = l.pred_id AND o.gt_id <> l.gt_id),
    kept AS (SELECT pair.gt_id, pair.pred_id, pt.token, greatest(pt.n - greatest(coalesce(og.n, 0) - coalesce(eg.n, 0), 0), 0) AS n, coalesce(eg.n, 0) AS e
             FROM pair JOIN pt ON pt.pred_id = pair.pred_id LEFT JOIN gt og ON og.gt_id = pair.other AND og.token = pt.token LEFT JOIN gt eg ON eg.gt_id = pair.gt_id AND eg.token = pt.token),
    f AS (SELECT gt_id, pred_id, sum(least(n, e)) AS hit, sum(n) AS size FROM kept GROUP BY ALL), s AS (SELECT gt_id, sum(n) AS n FROM gt GROUP BY 1),
    best AS (SELECT s.gt_id, max(coalesce(CASE WHEN size > 0 THEN 2 * hit / (s.n + size) END, 0)) AS score FROM s LEFT JOIN f ON f.gt_id = s.gt_id GROUP BY 1),
    e AS (SELECT d.doc_id // 4 AS page, d.doc_id AS id, d.lang, coalesce(d.lang = CASE WHEN p.doc_id % 5 = 0 THEN 'none' ELSE p.lang END, false) AS classified, score, score >= 0.8 AS attributed
          FROM documents d JOIN documents p ON p.doc_id = d.doc_id - CASE WHEN d.doc_id % 4 IN (1, 2) THEN 1 ELSE 0 END LEFT JOIN best ON best.gt_id = d.doc_id)"""


@query(f"WITH {ELEMENTS_SQL} SELECT page, id, true AS localised, classified, round(score::DOUBLE, 9) AS attribution, attributed, classified AND coalesce(attributed, true) AS passed FROM e")
def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every page with its three checks; attribution takes off what a merged prediction holds of its neighbours."""
    return L.elements(*token_pages(spark, sf_dir), ["page"]).select("page", "id", "localised", "classified", F.round("attribution", 9).alias("attribution"), "attributed", "passed")


@query(f"""WITH {ELEMENTS_SQL} SELECT lang, 1.0::DOUBLE AS localisation, round(avg(classified::INT), 9) AS classification, round(avg(attributed::INT), 9) AS attribution,
    round((count(*) + sum(classified::INT) + sum(coalesce(attributed, false)::INT)) / (2 * count(*) + count(attributed))::DOUBLE, 9) AS layout_rule_pass_rate, round(avg((classified AND coalesce(attributed, true))::INT), 9) AS layout_element_rule_pass_rate FROM e GROUP BY 1""")
def layout_rule_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of each class of elements (here a language): three checks pooled, and whole elements."""
    rows = L.elements(*token_pages(spark, sf_dir), ["page"]).withColumnRenamed("cls", "lang")
    out = L.rates(rows, ["lang"])
    return out.select("lang", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query(f"""WITH {TOKENS_SQL}, d AS (SELECT doc_id, lang FROM documents), n AS (SELECT pred_id, sum(n) AS n FROM pt GROUP BY 1),
    x AS (SELECT l.page, lang, l.pred_id, token, sum(gt.n) AS m FROM l JOIN d ON d.doc_id = l.gt_id JOIN gt ON gt.gt_id = l.gt_id WHERE lang IS NOT NULL GROUP BY ALL),
    own AS (SELECT DISTINCT l.page, lang, l.pred_id FROM l JOIN d ON d.doc_id = l.gt_id WHERE lang IS NOT NULL),
    h AS (SELECT own.page, own.lang, sum(n.n) AS tokens FROM own JOIN n ON n.pred_id = own.pred_id GROUP BY ALL), m AS (SELECT x.page, lang, sum(least(pt.n, m)) AS hit FROM x JOIN pt ON pt.pred_id = x.pred_id AND pt.token = x.token GROUP BY ALL)
    SELECT h.page, h.lang AS cls, round((coalesce(hit, 0) / tokens)::DOUBLE, 9) AS lap, tokens::BIGINT AS tokens FROM h LEFT JOIN m ON h.page = m.page AND h.lang = m.lang""")
def lap_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.class_precision(*token_pages(spark, sf_dir), ["page"]).withColumn("lap", F.round("lap", 9))


@query(f"""WITH {TOKENS_SQL},
    a AS (SELECT pt.page, sum(least(pt.n, coalesce(m, 0)))::DOUBLE AS hit, sum(pt.n)::DOUBLE AS n FROM pt LEFT JOIN (SELECT l.page, pred_id, token, sum(n) AS m FROM l JOIN gt ON l.page = gt.page AND l.gt_id = gt.gt_id GROUP BY ALL) x ON pt.page = x.page AND pt.pred_id = x.pred_id AND pt.token = x.token GROUP BY 1),
    q AS (SELECT DISTINCT page FROM g) SELECT q.page % 7 AS part, count(*) AS pages, round(avg(coalesce(hit / n, 1)), 9) AS lap, round(sum(hit) / sum(n), 9) AS lap_by_tokens FROM q LEFT JOIN a ON a.page = q.page GROUP BY 1""")
def attribution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page scores of each seventh part of the pages, by pages and by tokens."""
    pages_ = L.page_scores(*token_pages(spark, sf_dir), ["page"]).withColumn("part", F.col("page") % 7)
    return L.batch_report(pages_, ["part"]).select("part", "pages", F.round("lap", 9).alias("lap"), F.round("lap_by_tokens", 9).alias("lap_by_tokens"))


@query(f"""WITH {APART_SQL}, a AS (SELECT page, sum(CASE WHEN there THEN iou ELSE 0 END) AS p, count(*) AS g, count(CASE WHEN there THEN 1 END) AS n FROM m GROUP BY 1)
    SELECT page, round((p / g)::DOUBLE, 9) AS iou, round((p / g)::DOUBLE, 9) AS recall FROM a""")
def field_bbox_set_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions lie inside their boxes, so what they cover is both the intersection and all of them."""
    gt, pred, _ = apart(spark, sf_dir)
    return L.set_iou(gt.withColumnRenamed("gt_id", "id"), pred.withColumnRenamed("pred_id", "id"), ["page"]).withColumns({c: F.round(c, 9) for c in ("iou", "recall")})


# A field of each line: its value, where it stands, and a word there that is the value, another one, elsewhere, or missing.
FIELDS_SQL = """r AS (SELECT l_orderkey AS test_id, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
    f AS (SELECT test_id, i, k % 6 NOT IN (2, 3) AS loc, k % 6 NOT IN (1, 2, 3) AS attr, CASE k % 6 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 0.6 ELSE 1 END AS iou FROM r)"""


@query(f"""WITH {FIELDS_SQL} SELECT test_id, round(avg(attr::INT)::DOUBLE, 9) AS parse_field_element_pass_rate, round(((sum(loc::INT) + count(*) + sum(attr::INT)) / (3 * count(*)))::DOUBLE, 9) AS parse_field_rule_pass_rate, round(avg(loc::INT)::DOUBLE, 9) AS parse_field_localization_pass_rate,
    round(avg(iou)::DOUBLE, 9) AS parse_field_avg_iou, round(coalesce(avg(CASE WHEN loc THEN iou END), 0)::DOUBLE, 9) AS parse_field_avg_iou_matched FROM f GROUP BY 1""")
def parse_field_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounding of a value for each line of an order among the words of its page."""
    i, k = F.col("i"), F.col("k")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("test_id"), F.col("l_partkey").alias("k"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("i"))
    box = F.struct(F.lit(1).alias("page"), F.lit(0.0).alias("x0"), (20.0 * i).alias("y0"), F.lit(100.0).alias("x1"), (20.0 * i + 10).alias("y1"))
    rules = rows.select("test_id", F.concat(F.lit("lines["), i.cast("string"), F.lit("].part")).alias("field_path"), k.cast("string").alias("expected"), F.lit("number").alias("kind"), F.array(box).alias("boxes"))
    units = rows.where(k % 6 != 3).select("test_id", F.lit("word").alias("granularity"), i.alias("rank"), F.when(k % 6 == 1, "none").otherwise(k.cast("string")).alias("text"), F.lit(1).alias("page"), F.when(k % 6 == 2, 200.0).otherwise(0.0).alias("x0"), (20.0 * i).alias("y0"), F.when(k % 6 == 2, 300.0).otherwise(100.0).alias("x1"), (20.0 * i + F.when(k % 6 == 4, 6.0).otherwise(10.0)).alias("y1"))
    out = G.field_metrics(G.field_rules(rules, units), ["test_id"])
    return out.select("test_id", *(F.round(f"parse_field_{c}", 9).alias(f"parse_field_{c}") for c in ("element_pass_rate", "rule_pass_rate", "localization_pass_rate", "avg_iou", "avg_iou_matched")))


@query("""SELECT o_custkey AS k, count(*) AS records, round(avg(CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2 / 3.0 ELSE 0 END)::DOUBLE, 9) AS record_accuracy, round(avg((o_orderkey % 4 < 2)::INT)::DOUBLE, 9) AS record_grounded_recall FROM orders GROUP BY 1""")
def record_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as records: some come back whole, some with a field changed, some with nothing left."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("rank"), F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("b"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("c"))
    part = lambda c, kept: F.when(kept, F.col(c)).otherwise(F.concat(F.lit("other"), F.col(c)))
    r = F.col("rank") % 4
    found = o.select("k", (F.col("rank") + 1_000_000).alias("rank"), part("a", r < 2).alias("a"), part("b", r < 2).alias("b"), part("c", (r == 0) | (r == 2)).alias("c"))
    m = G.record_metrics(o, found, G.aligned_records(o, found, "k", ["a", "b", "c"]), "k")
    n = o.groupBy("k").agg(F.count(F.lit(1)).alias("records"))
    return n.join(m, "k").select("k", "records", *(F.round(c, 9).alias(c) for c in ("record_accuracy", "record_grounded_recall")))


@query(f"""WITH c AS (SELECT page, gt_id, x0, (y0 + y1) / 2 AS yc, y1 - y0 AS h, 't' || gt_id::VARCHAR AS t FROM ({GT_SQL})), m AS (SELECT *, avg(h) OVER (PARTITION BY page) AS mean, yc - lag(yc) OVER (PARTITION BY page ORDER BY yc, x0) AS gap FROM c),
    n AS (SELECT *, sum(CASE WHEN gap > mean / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY yc, x0) AS line FROM m) SELECT page, line, string_agg(t, ' ' ORDER BY x0, t) AS text FROM n GROUP BY 1, 2""")
def line_grouping_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, _ = pages(spark, sf_dir)
    return B.lines(gt.withColumn("text", F.concat(F.lit("t"), F.col("gt_id").cast("string"))), ["page"])


@query(f"""WITH c AS (SELECT page, gt_id AS cell_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({GT_SQL})) SELECT c.page, cell_id, min(pred_id) AS box_id FROM c JOIN ({PRED_SQL}) p ON c.page = p.page AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY 1, 2""")
def cells_to_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = pages(spark, sf_dir)
    return B.cells_in_boxes(gt.withColumnRenamed("gt_id", "cell_id"), pred.withColumnRenamed("pred_id", "box_id"), ["page"])


MAP = [("STANDARD", "Text"), ("SMALL", "Caption"), ("MEDIUM", "Table"), ("LARGE", "Picture"), ("ECONOMY", "Formula")]


@query("WITH m(raw, canonical) AS (VALUES {}) SELECT p_partkey, canonical FROM part JOIN m ON string_split(p_type, ' ')[1] = raw".format(", ".join(f"('{a}', '{b}')" for a, b in MAP)))
def label_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ")[0].alias("raw_label"))
    return B.project_labels(rows, spark.createDataFrame(MAP, "raw_label string, canonical string")).select("p_partkey", "canonical")


@query(f"SELECT page, gt_id, x0 / 256::DOUBLE AS x0, y0 / 128::DOUBLE AS y0, x1 / 256::DOUBLE AS x1, y1 / 128::DOUBLE AS y1 FROM ({GT_SQL})")
def box_to_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir)[0].select("page", "gt_id", *B.to_unit([F.col(c) for c in B.BOX], F.lit(256.0), F.lit(128.0)))

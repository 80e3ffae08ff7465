"""Fusion and evaluation over signal_rows and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import doc_label, excerpt
from lexmill.operators import evaluation as ev
from lexmill.operators import fusion as fu
from lexmill.session import load

GRID = ev.simplex_grid(fu.SIGNALS, 0.1, {"rel": 0.3})


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "signal_rows").select("qid", "doc_id", *fu.SIGNALS).distinct().filter("rel is not null and qid is not null and doc_id is not null")


def _qrels(spark, sf) -> DataFrame:
    """Grades of the candidates: full continuity 2, partial 1, none 0."""
    g = F.when(F.col("cont") >= 1, 2).when(F.col("cont") >= 0.5, 1).otherwise(0)
    return _signals(spark, sf).groupBy("qid", "doc_id").agg(F.max(g).alias("grade"))


def _second(spark, sf) -> DataFrame:
    """A second judge, one grade higher where the year's last digit is odd."""
    return _qrels(spark, sf).withColumn("grade", F.least(F.lit(2), F.col("grade") + F.substring("doc_id", 4, 1).cast("int") % 2))


def _runs(spark, sf) -> DataFrame:
    return ev.run_ranks(load(spark, sf, "hits").select("qid", "doc_id", "system_name", "rel"))


def _harmful(spark, sf) -> DataFrame:
    return load(spark, sf, "evidence").filter("label = 'overruled' and doc_id is not null").select("doc_id").distinct()


def _metrics(spark, sf) -> DataFrame:
    return ev.query_metrics(_runs(spark, sf), _qrels(spark, sf), _harmful(spark, sf))


def minmax_norm(spark, sf):
    """F1, F2."""
    return fu.normalised(_signals(spark, sf)).select("qid", "doc_id", *[F.round(f"n_{s}", 6).alias(f"n_{s}") for s in fu.SIGNALS])


def _fuse(name: str):
    def run(spark, sf):
        r = fu.ranked(fu.fused(_signals(spark, sf), {name: fu.CONFIGS[name]}), 10)
        return r.select("qid", "doc_id", "rank", F.round("final", 6).alias("final"))

    run.__doc__ = f"F5-F7: the ten best of every query under {name}."
    return run


def compare_configs(spark, sf):
    """ranks of each document under every configuration."""
    return fu.ranks_by_config(fu.ranked(fu.fused(_signals(spark, sf)), 10), list(fu.CONFIGS))


def explained(spark, sf):
    """Explanations and contributions of the best three."""
    r = fu.ranked(fu.fused(_signals(spark, sf), {"full": fu.CONFIGS["full"]}), 3)
    return r.select("qid", "doc_id", fu.explanation().alias("why"), F.round(F.aggregate(F.map_values(fu.contributions()), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def evidence_shown(spark, sf):
    """F8: at most three evidence items, the reason counting all."""
    rows = load(spark, sf, "signal_rows").select("qid", "doc_id", F.size("evidence").alias("n"), F.array_join(F.transform(F.slice("evidence", 1, fu.SHOWN), lambda e: e["citing_doc"]), ",").alias("shown"))
    return rows.distinct()


def contract_checks(spark, sf):
    """Violations in the result lists."""
    return fu.violations(load(spark, sf, "hits").select("qid", F.concat_ws("/", "system_name", "doc_id").alias("doc_id"), "rel").distinct())


def metrics(spark, sf):
    """E1-E6 per query and system."""
    return _metrics(spark, sf).select("system", "qid", *[F.round(m, 6).alias(m) for m in ev.METRICS])


def metric_means(spark, sf):
    """E6."""
    return ev.means(_metrics(spark, sf)).select("system", "n_ap", *[F.round(m, 6).alias(m) for m in ev.METRICS])


def pool_union(spark, sf):
    """E8."""
    return ev.pool(_runs(spark, sf), 20)


def pool_overlap(spark, sf):
    """Pooled documents by the number of lists that have them."""
    return ev.pool(_runs(spark, sf), 20).groupBy("n_systems").agg(F.count(F.lit(1)).alias("documents"))


def drop_judged(spark, sf):
    """E9."""
    return ev.unjudged(ev.pool(_runs(spark, sf), 20), _qrels(spark, sf))


def default_grades(spark, sf):
    """Pooled documents without a judgement have grade 0."""
    return ev.pool(_runs(spark, sf), 20).join(_qrels(spark, sf), ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("grade", F.lit(0)).alias("grade"))


def blind_order(spark, sf):
    """E10."""
    return ev.blind_order(ev.pool(_runs(spark, sf), 20).select("qid", "doc_id"), 7)


def judge_sheet(spark, sf):
    """Pooled documents with their labels and an excerpt of the holding, else of the text."""
    j = load(spark, sf, "judgments").select("doc_id", "title", "decision_date", "bench_size", F.coalesce(F.nullif(F.try_element_at("zones", F.lit("holding")), F.lit("")), "text").alias("body"))
    j = j.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("decision_date").alias("date"), F.min("bench_size").alias("bench"), F.min("body").alias("body"))
    return ev.pool(_runs(spark, sf), 5).join(j, "doc_id").select("qid", "doc_id", doc_label(F.col("title"), F.col("date"), F.col("bench")).alias("label"), F.length(excerpt(F.col("body"))).alias("excerpt_length"))


def sheet_check(spark, sf):
    """A judged sheet against the pool of depth 5."""
    return ev.sheet_problems(_qrels(spark, sf).filter("grade > 0"), ev.pool(_runs(spark, sf), 5))


def reconcile(spark, sf):
    """Two judges, the third settles the documents of even benches."""
    a, b = _qrels(spark, sf), _second(spark, sf)
    return ev.reconciled(a, b, a.filter(F.substring("doc_id", 3, 1) == "0"))


def merge_qrels(spark, sf):
    """E14."""
    return ev.merged_qrels(_qrels(spark, sf).filter("grade >= 1"), _second(spark, sf))


def _kappa(quadratic: bool):
    def run(spark, sf):
        pairs = _qrels(spark, sf).join(_second(spark, sf).withColumnRenamed("grade", "other"), ["qid", "doc_id"])
        return ev.kappa(pairs, "grade", "other", quadratic).select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))

    run.__doc__ = "G18, E15: agreement beyond chance" + (", quadratic." if quadratic else ".")
    return run


def confusion(spark, sf):
    """E15."""
    return _qrels(spark, sf).join(_second(spark, sf).withColumnRenamed("grade", "other"), ["qid", "doc_id"]).groupBy("grade", "other").agg(F.count(F.lit(1)).alias("n"))


def simplex_grid(spark, sf):
    """The weightings of four signals in tenths with rel at least .3."""
    return spark.createDataFrame([tuple(round(v[s], 1) for s in fu.SIGNALS) for v in GRID], ", ".join(f"{s} double" for s in fu.SIGNALS))


def tune_grid(spark, sf):
    """Mean P@10 of every weighting; the stated grid meets each candidate on its own."""
    configs = {",".join(f"{v[s]:.1f}" for s in fu.SIGNALS): v for v in GRID}
    top = fu.ranked(fu.fused(_signals(spark, sf), configs), 10)
    hit = top.join(_qrels(spark, sf).filter("grade >= 1"), ["qid", "doc_id"], "left")
    per = hit.groupBy("config", "qid").agg((F.count("grade") / 10.0).alias("p10"))
    return per.groupBy("config").agg(F.round(F.avg("p10"), 6).alias("p10"))


def tune_winner(spark, sf):
    """The best weighting: by the metric, then nearest to the stated one, then the smallest weights in order."""
    start = fu.weights("full")
    w = [F.split("config", ",")[i].cast("double") for i in range(len(fu.SIGNALS))]
    away = F.round(sum((F.abs(x - start[s]) for x, s in zip(w, fu.SIGNALS)), F.lit(0.0)), 12)
    return tune_grid(spark, sf).orderBy(F.desc(F.round("p10", 12)), away, *w).limit(1)


def ablation_grouping_sets(spark, sf):
    """Metric means by system, and by system and parity of the query number, in one pass."""
    m = _metrics(spark, sf).withColumn("kind", F.when(F.substring("qid", -1, 1).cast("int") % 2 == 0, "even").otherwise("odd"))
    return m.groupingSets([[F.col("system")], [F.col("system"), F.col("kind")]], F.col("system"), F.col("kind")).agg(F.round(F.avg("ndcg10"), 6).alias("ndcg10"), F.count(F.lit(1)).alias("n"))


def harmful_rank_pivot(spark, sf):
    """The rank of every overruled document under each system, if any has it in its ten best."""
    r = _runs(spark, sf).join(_harmful(spark, sf), "doc_id", "left_semi").withColumn("system", F.coalesce("system", F.lit("null")))
    # The systems compared are few; one without an overruled document keeps its column.
    names = load(spark, sf, "hits").filter("rel is not null").select(F.coalesce("system_name", F.lit("null")).alias("s")).distinct()
    p = r.groupBy("qid", "doc_id").pivot("system", sorted(x["s"] for x in names.collect())).agg(F.min("rn"))
    best = r.filter("rn <= 10").select("qid", "doc_id").distinct()
    return p.join(best, ["qid", "doc_id"], "left_semi")


def check_cube(spark, sf):
    """Candidates by grade and presence of a reason, with all totals."""
    rows = _signals(spark, sf).join(_qrels(spark, sf), ["qid", "doc_id"]).withColumn("cited", F.coalesce("auth", F.lit(0.0)) > 0.01)
    return rows.cube("grade", "cited").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def paired_bootstrap(spark, sf):
    """nDCG of the zone system less the cosine system."""
    m = _metrics(spark, sf)
    a, b = (m.filter(F.col("system") == s).select("qid", F.col("ndcg10").alias(c)) for s, c in (("lnc_ltc", "a"), ("zone_bm25", "b")))
    return ev.bootstrap(a.join(b, "qid").withColumn("pair", F.lit("zone_bm25 - lnc_ltc")), "a", "b")


QUERIES = {
    f.__name__: f
    for f in (minmax_norm, compare_configs, explained, evidence_shown, contract_checks, metrics, metric_means, pool_union, pool_overlap, drop_judged, default_grades, blind_order, judge_sheet, sheet_check, reconcile, merge_qrels, confusion, simplex_grid, tune_grid, tune_winner, ablation_grouping_sets, harmful_rank_pivot, check_cube, paired_bootstrap)
} | {"fuse_full": _fuse("full"), "fuse_b1": _fuse("b1"), "fuse_b0": _fuse("b0"), "kappa": _kappa(False), "kappa_quadratic": _kappa(True)}

_S = "s AS (SELECT DISTINCT qid, doc_id, rel, coalesce(cont, 0) AS cont, coalesce(health, 0) AS health, coalesce(auth, 0) AS auth FROM signal_rows WHERE rel IS NOT NULL AND qid IS NOT NULL AND doc_id IS NOT NULL)"
_MM = "CASE WHEN max({0}) OVER w = min({0}) OVER w THEN CASE WHEN max({0}) OVER w > 0 THEN 1.0 ELSE 0.0 END ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
_N = f"{_S}, n AS (SELECT *, {_MM.format('rel')} AS n_rel, least(greatest(cont, 0), 1) AS n_cont, least(greatest(health, 0), 1) AS n_health, {_MM.format('auth')} AS n_auth FROM s WINDOW w AS (PARTITION BY qid))"
_CFG = "cfg(config, w_rel, w_cont, w_health, w_auth) AS (VALUES ('b0', 1.0, 0.0, 0.0, 0.0), ('b1', 0.7, 0.3, 0.0, 0.0), ('full', 0.5, 0.2, 0.2, 0.1))"
_F = f"{_N}, {_CFG}, f AS (SELECT *, least(greatest(w_rel::DOUBLE * n_rel + w_cont::DOUBLE * n_cont + w_health::DOUBLE * n_health + w_auth::DOUBLE * n_auth, 0), 1) AS final FROM n CROSS JOIN cfg), rk AS (SELECT *, row_number() OVER (PARTITION BY qid, config ORDER BY round(final, 12) DESC, rel DESC, doc_id) AS rank FROM f)"
_QR = f"{_S}, qr AS (SELECT qid, doc_id, max(CASE WHEN cont >= 1 THEN 2 WHEN cont >= 0.5 THEN 1 ELSE 0 END) AS grade FROM s GROUP BY ALL), q2 AS (SELECT qid, doc_id, least(2, grade + substr(doc_id, 4, 1)::INT % 2) AS grade FROM qr)"
_RUN = "h AS (SELECT system_name AS system, qid, doc_id, max(rel) AS rel FROM hits WHERE rel IS NOT NULL GROUP BY ALL), run AS (SELECT system, qid, doc_id, row_number() OVER (PARTITION BY system, qid ORDER BY rel DESC, doc_id) AS rn FROM h)"
_M = f"""{_QR}, {_RUN},
harm AS (SELECT DISTINCT doc_id FROM evidence WHERE label = 'overruled' AND doc_id IS NOT NULL),
pos AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, doc_id) AS a FROM qr),
ideal AS (SELECT qid, count(*) FILTER (grade >= 1) AS n_rel, sum((pow(2, grade) - 1) / log2(a + 1)) FILTER (a <= 10) AS idcg FROM pos GROUP BY qid),
g AS (SELECT run.*, qr.grade, n_rel, idcg, (harm.doc_id IS NOT NULL)::INT AS harm, coalesce(qr.grade >= 1, false)::INT AS r FROM run JOIN ideal USING (qid) LEFT JOIN qr ON qr.qid = run.qid AND qr.doc_id = run.doc_id LEFT JOIN harm ON harm.doc_id = run.doc_id),
c AS (SELECT *, sum(r) OVER (PARTITION BY system, qid ORDER BY rn) AS so_far FROM g),
m AS (SELECT system, qid, coalesce(sum(r) FILTER (rn <= 5), 0) / 5.0 AS p5, coalesce(sum(r) FILTER (rn <= 10), 0) / 10.0 AS p10, coalesce(sum(r) FILTER (rn <= 10), 0) / nullif(any_value(n_rel), 0) AS r10,
  coalesce(sum(so_far / rn) FILTER (r = 1 AND rn <= 20), 0) / nullif(any_value(n_rel), 0) AS ap, coalesce(sum((pow(2, grade) - 1) / log2(rn + 1)) FILTER (rn <= 10), 0) / nullif(any_value(idcg), 0) AS ndcg10,
  count(grade) FILTER (rn <= 10) / 10.0 AS judged10, coalesce(sum(harm) FILTER (rn <= 10), 0) / 10.0 AS harmful10 FROM c GROUP BY ALL)"""
_R6 = ", ".join(f"round({m}, 6) AS {m}" for m in ev.METRICS)
_POOL = "pool AS (SELECT qid, doc_id, count(*) AS n_systems, min(rn) AS best_rank FROM run WHERE rn <= {0} GROUP BY ALL)"
_AB = "ab AS (SELECT qr.grade AS x, q2.grade AS y FROM qr JOIN q2 USING (qid, doc_id))"


def _kappa_sql(cost: str) -> str:
    return f"WITH {_QR}, {_AB}, c AS (SELECT x, y, count(*) AS n FROM ab GROUP BY ALL), rx AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), ry AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), t AS (SELECT sum(n) AS t, sum(n) FILTER (x = y) AS same, sum({cost} * n) AS seen FROM c), e AS (SELECT sum({cost} * nx * ny) AS e FROM rx CROSS JOIN ry) SELECT t::BIGINT AS n, round(same / t, 6) AS agreement, round(1 - seen / (e / t), 6) AS kappa FROM t CROSS JOIN e"


ORACLE = {
    "minmax_norm": f"WITH {_N} SELECT qid, doc_id, round(n_rel, 6) AS n_rel, round(n_cont, 6) AS n_cont, round(n_health, 6) AS n_health, round(n_auth, 6) AS n_auth FROM n",
    **{f"fuse_{c}": f"WITH {_F} SELECT qid, doc_id, rank, round(final, 6) AS final FROM rk WHERE rank <= 10 AND config = '{c}'" for c in fu.CONFIGS},
    "compare_configs": f"WITH {_F} SELECT qid, doc_id, min(rank) FILTER (config = 'b0') AS rank_b0, min(rank) FILTER (config = 'b1') AS rank_b1, min(rank) FILTER (config = 'full') AS rank_full FROM rk WHERE rank <= 10 GROUP BY ALL",
    "explained": f"WITH {_F} SELECT qid, doc_id, concat_ws(' | ', {', '.join(f"printf('{s} %.3f x %.2f = %.3f', n_{s}::DOUBLE, w_{s}::DOUBLE, (n_{s} * w_{s}::DOUBLE)::DOUBLE)" for s in fu.SIGNALS)}) AS why, round(final, 6) AS total FROM rk WHERE config = 'full' AND rank <= 3",
    "evidence_shown": "SELECT DISTINCT qid, doc_id, len(evidence) AS n, array_to_string(list_transform(evidence[1:3], lambda e: e.citing_doc), ',') AS shown FROM signal_rows",
    "contract_checks": "WITH d AS (SELECT DISTINCT qid, concat_ws('/', system_name, doc_id) AS doc_id, rel FROM hits) SELECT qid, doc_id, 'repeated' AS problem FROM d GROUP BY ALL HAVING count(*) > 1 UNION SELECT qid, doc_id, 'score' FROM d WHERE rel IS NULL OR isnan(rel) OR rel < 0",
    "metrics": f"WITH {_M} SELECT system, qid, {_R6} FROM m",
    "metric_means": f"WITH {_M} SELECT system, count(ap) AS n_ap, {', '.join(f'round(avg({x}), 6) AS {x}' for x in ev.METRICS)} FROM m GROUP BY system",
    "pool_union": f"WITH {_RUN}, {_POOL.format(20)} SELECT * FROM pool",
    "pool_overlap": f"WITH {_RUN}, {_POOL.format(20)} SELECT n_systems, count(*) AS documents FROM pool GROUP BY n_systems",
    "drop_judged": f"WITH {_QR}, {_RUN}, {_POOL.format(20)} SELECT * FROM pool ANTI JOIN qr USING (qid, doc_id)",
    "default_grades": f"WITH {_QR}, {_RUN}, {_POOL.format(20)} SELECT qid, doc_id, coalesce(grade, 0) AS grade FROM pool LEFT JOIN qr USING (qid, doc_id)",
    "blind_order": f"WITH {_RUN}, {_POOL.format(20)} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY sha256(concat_ws('|', '7', qid, doc_id)), doc_id) AS place FROM pool",
    "sheet_check": f"WITH {_QR}, {_RUN}, {_POOL.format(5)}, fl AS (SELECT qid, doc_id, count(*) AS n, count(grade) AS gr FROM qr WHERE grade > 0 GROUP BY ALL), b AS (SELECT coalesce(pool.qid, fl.qid) AS qid, coalesce(pool.doc_id, fl.doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN pool.qid IS NULL THEN 'extra' WHEN n > 1 THEN 'repeated' WHEN gr < n THEN 'blank' END AS problem FROM pool FULL OUTER JOIN fl ON pool.qid = fl.qid AND pool.doc_id = fl.doc_id) SELECT * FROM b WHERE problem IS NOT NULL",
    "reconcile": f"WITH {_QR} SELECT a.qid, a.doc_id, CASE WHEN a.grade = b.grade OR substr(a.doc_id, 3, 1) = '0' THEN a.grade END AS grade, CASE WHEN a.grade = b.grade THEN 'agreed' WHEN substr(a.doc_id, 3, 1) = '0' THEN 'adjudicated' ELSE 'unresolved' END AS state FROM qr a JOIN q2 b USING (qid, doc_id)",
    "merge_qrels": f"WITH {_QR}, o AS (SELECT * FROM qr WHERE grade >= 1) SELECT coalesce(o.qid, q2.qid) AS qid, coalesce(o.doc_id, q2.doc_id) AS doc_id, coalesce(o.grade, q2.grade) AS grade, coalesce(o.grade <> q2.grade, false) AS conflict FROM o FULL OUTER JOIN q2 ON o.qid = q2.qid AND o.doc_id = q2.doc_id",
    "kappa": _kappa_sql("(x <> y)::DOUBLE"),
    "kappa_quadratic": _kappa_sql("pow((x - y) / 2.0, 2)"),
    "confusion": f"WITH {_QR}, {_AB} SELECT x AS grade, y AS other, count(*) AS n FROM ab GROUP BY ALL",
    "simplex_grid": "SELECT round(a / 10.0, 1)::DOUBLE AS rel, round(b / 10.0, 1)::DOUBLE AS cont, round(c / 10.0, 1)::DOUBLE AS health, round((10 - a - b - c) / 10.0, 1)::DOUBLE AS auth FROM range(3, 11) x(a), range(0, 11) y(b), range(0, 11) z(c) WHERE a + b + c <= 10",
    "tune_grid": f"WITH {_N}, qr AS (SELECT qid, doc_id, max(CASE WHEN cont >= 1 THEN 2 WHEN cont >= 0.5 THEN 1 ELSE 0 END) AS grade FROM s GROUP BY ALL), g AS (SELECT a / 10::DOUBLE AS wr, b / 10::DOUBLE AS wc, c / 10::DOUBLE AS wh, (10 - a - b - c) / 10::DOUBLE AS wa FROM range(3, 11) x(a), range(0, 11) y(b), range(0, 11) z(c) WHERE a + b + c <= 10), f AS (SELECT printf('%.1f,%.1f,%.1f,%.1f', wr, wc, wh, wa) AS config, n.*, least(greatest(wr * n_rel + wc * n_cont + wh * n_health + wa * n_auth, 0), 1) AS final FROM n CROSS JOIN g), rk AS (SELECT *, row_number() OVER (PARTITION BY qid, config ORDER BY round(final, 12) DESC, rel DESC, doc_id) AS rank FROM f), p AS (SELECT config, rk.qid, count(grade) FILTER (grade >= 1) / 10.0 AS p10 FROM rk LEFT JOIN qr ON qr.qid = rk.qid AND qr.doc_id = rk.doc_id WHERE rank <= 10 GROUP BY ALL) SELECT config, round(avg(p10), 6) AS p10 FROM p GROUP BY config",
    "ablation_grouping_sets": f"WITH {_M}, k AS (SELECT *, CASE WHEN right(qid, 1)::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM m) SELECT system, kind, round(avg(ndcg10), 6) AS ndcg10, count(*) AS n FROM k GROUP BY GROUPING SETS ((system), (system, kind))",
    "harmful_rank_pivot": f"WITH {_RUN}, harm AS (SELECT DISTINCT doc_id FROM evidence WHERE label = 'overruled') SELECT qid, doc_id, min(rn) FILTER (system = 'flat_bm25') AS flat_bm25, min(rn) FILTER (system = 'lnc_ltc') AS lnc_ltc, min(rn) FILTER (system = 'zone_bm25') AS zone_bm25 FROM run SEMI JOIN harm USING (doc_id) GROUP BY ALL HAVING min(rn) <= 10",
    "check_cube": f"WITH {_QR}, r AS (SELECT grade, auth > 0.01 AS cited FROM s JOIN qr USING (qid, doc_id)) SELECT grade, cited, count(*) AS n, grouping_id(grade, cited)::INT AS level FROM r GROUP BY CUBE (grade, cited)",
}
_START = fu.weights("full")
ORACLE["tune_winner"] = f"SELECT config, p10 FROM ({ORACLE['tune_grid']}) ORDER BY p10 DESC, round({' + '.join(f"abs(split_part(config, ',', {i})::DOUBLE - {_START[s]!r})" for i, s in enumerate(fu.SIGNALS, 1))}, 12), {', '.join(f"split_part(config, ',', {i})::DOUBLE" for i in range(1, 5))} LIMIT 1"

"""SQL for DuckDB that gives the rows of the queries, over the same tables."""

from __future__ import annotations

from ..config import FEATURE_WEIGHTS, FEATURES, PANEL_WEIGHTS, PanelConfig

TAU = PanelConfig().rank_threshold
BINDING = """b AS (
  SELECT n_name AS s, replace(upper(p_name), ' ', '') || chr(CAST(65 + p_size % 26 AS INT)) AS p,
         'HLA-' || ['A', 'B', 'C'][1 + CAST(substr(p_brand, 7) AS INT) % 3] || '*' || lpad(substr(p_brand, 7), 2, '0') || ':01' AS m,
         l_extendedprice / 1000.0 AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
PANEL = """h0 AS (
  SELECT n_name AS population, r_name AS region, ['A', 'B', 'C'][1 + CAST(substr(p_brand, 7) AS INT) % 3] AS locus,
         ['A', 'B', 'C'][1 + CAST(substr(p_brand, 7) AS INT) % 3] || '*' || lpad(substr(p_brand, 7), 2, '0') || ':01' AS allele
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
), ac AS (SELECT population, region, locus, allele, count(*) AS n FROM h0 GROUP BY ALL),
ss AS (SELECT n_name AS population, count(*) AS sample_size FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
panel AS (
  SELECT population, region, locus, allele, CAST(0.95 AS DOUBLE) * n / sum(n) OVER (PARTITION BY population, locus) AS f, CAST(sample_size AS DOUBLE) AS w
  FROM ac JOIN ss USING (population)
)"""


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


KMERS = """k AS (SELECT DISTINCT p, unnest([substr(p, CAST(i AS INT), 7) FOR i IN range(1, length(p) - 5)]) AS g FROM (SELECT DISTINCT p FROM b) WHERE length(p) >= 7)"""
#: Least peptide reachable in each sample, over the star edges of shared windows.
FAMILIES = """sp AS (SELECT DISTINCT s, p FROM b),
sk AS (SELECT s, p, g FROM sp JOIN k USING (p)),
st AS (SELECT DISTINCT s, p, min(p) OVER (PARTITION BY s, g) AS q FROM sk),
ed AS (SELECT s, p AS x, q AS y FROM st UNION SELECT s, q, p FROM st),
reach AS (SELECT s, p AS x, p AS y FROM sp UNION SELECT reach.s, reach.x, ed.y FROM reach JOIN ed ON reach.s = ed.s AND reach.y = ed.x),
fam AS (SELECT s, x AS p, min(y) AS family FROM reach GROUP BY ALL)"""
WITH = f"WITH RECURSIVE {BINDING}, {KMERS}, {FAMILIES}"

BASIC = "SELECT s, count(*) AS num_rows, count(DISTINCT p) AS num_unique_peptides, count(DISTINCT m) AS num_unique_HLAs_hit, count(*) / count(DISTINCT p) AS rows_per_unique_peptide FROM b GROUP BY s"
RANKS = "SELECT s, min(r) AS best_rank, avg(r) AS mean_rank, median(r) AS median_rank, coalesce(stddev_samp(r), 0) AS rank_std FROM b GROUP BY s"
TOP = "SELECT s, avg(r) FILTER (k <= 3) AS mean_top3_rank, avg(r) AS mean_top5_rank FROM (SELECT s, r, row_number() OVER (PARTITION BY s ORDER BY r) AS k FROM b) WHERE k <= 5 GROUP BY s"
PROMISCUITY = """SELECT s, avg(a) AS peptide_promiscuity_mean, max(a) AS peptide_promiscuity_max, avg(length(p)) AS mean_peptide_length, avg(best) AS mean_best_rank_per_peptide
FROM (SELECT s, p, count(DISTINCT m) AS a, min(r) AS best FROM b GROUP BY ALL) GROUP BY s"""
ENTROPY = """SELECT s, -sum(q * ln(q + pow(2.0, -52))) AS hla_entropy FROM (SELECT s, m, count(*) / sum(count(*)) OVER (PARTITION BY s) AS q FROM b GROUP BY s, m) GROUP BY s"""
FAMILY = """SELECT s, count(*) AS num_peptide_families, max(n) AS largest_peptide_family_size, sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) AS frac_peptides_in_family_size_gt_1, avg(best) AS mean_best_rank_per_family
FROM (SELECT s, family, count(*) AS n, min(best) AS best FROM fam JOIN (SELECT s, p, min(r) AS best FROM b GROUP BY ALL) USING (s, p) GROUP BY s, family) GROUP BY s"""
_PARTS = {
    "basic": (BASIC, ["num_rows", "num_unique_peptides", "num_unique_HLAs_hit"], ["rows_per_unique_peptide"]),
    "ranks": (RANKS, [], ["best_rank", "mean_rank", "median_rank", "rank_std"]),
    "top": (TOP, [], ["mean_top3_rank", "mean_top5_rank"]),
    "promiscuity": (PROMISCUITY, ["peptide_promiscuity_max"], ["peptide_promiscuity_mean", "mean_peptide_length", "mean_best_rank_per_peptide"]),
    "entropy": (ENTROPY, [], ["hla_entropy"]),
    "family": (FAMILY, ["num_peptide_families", "largest_peptide_family_size"], ["frac_peptides_in_family_size_gt_1", "mean_best_rank_per_family"]),
}


def _columns(*names: str) -> str:
    return ", ".join(["s AS sample"] + [x for n in names for x in [f"{long(c)} AS {c}" for c in _PARTS[n][1]] + [f"{r(c)} AS {c}" for c in _PARTS[n][2]]])


def _part(name: str, head: str = f"WITH {BINDING}") -> str:
    return f"{head} SELECT {_columns(name)} FROM ({_PARTS[name][0]})"


_ALL = " JOIN ".join(f"({sql})" + (" USING (s)" if k else "") for k, (sql, _, _) in enumerate(_PARTS.values()))
#: sample_idx, pos and z of the thirteen features; then distances.
ZSCORES = f"""ft AS (SELECT * FROM {_ALL}),
lg AS (SELECT s, pos, x FROM (SELECT s, unnest(range({len(FEATURES)})) AS pos, unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURES)}]) AS x FROM ft)),
sd AS (SELECT pos, avg(x) AS mu, stddev_samp(x) AS sd FROM lg GROUP BY pos),
z AS (SELECT s, dense_rank() OVER (ORDER BY s) AS i, pos, CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END AS z FROM lg JOIN sd USING (pos))"""
EDGES = f"""w AS (SELECT i, s, pos, z * [{", ".join(map(str, FEATURE_WEIGHTS.values()))}][pos + 1] AS v FROM z),
e AS (SELECT a.i AS i, c.i AS j, sqrt(sum((a.v - c.v) * (a.v - c.v))) AS d FROM w a JOIN w c ON a.pos = c.pos AND a.i <= c.i GROUP BY a.i, c.i),
es AS (SELECT i, j, d FROM e UNION SELECT j, i, d FROM e)"""
#: z-scores of the embeddings, which weigh 1 each.
EMBEDDED = """WITH lg AS (SELECT vec_id + 1 AS i, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
sd AS (SELECT pos, avg(x) AS mu, stddev_samp(x) AS sd FROM lg GROUP BY pos),
e AS (SELECT i, pos, CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END AS v FROM lg JOIN sd USING (pos))"""
TREE = """fw AS (
  SELECT 0 AS k, i, j, d FROM es
  UNION ALL
  SELECT a.k + 1, a.i, a.j, least(a.d, greatest(x.d, y.d)) FROM fw a JOIN fw x ON x.k = a.k AND x.i = a.i AND x.j = a.k + 1 JOIN fw y ON y.k = a.k AND y.i = a.k + 1 AND y.j = a.j
  WHERE a.k < (SELECT max(i) FROM es)
), mm AS (SELECT i, j, d FROM fw WHERE k = (SELECT max(i) FROM es)),
death AS (SELECT es.d AS d, row_number() OVER (ORDER BY es.d) AS k, count(*) OVER () AS n FROM es JOIN mm USING (i, j) WHERE es.i < es.j AND es.d = mm.d)"""
PCT = """pct AS (
  SELECT max(d) FILTER (k = floor(h)) + max(h - floor(h)) * (max(d) FILTER (k = least(floor(h) + 1, n)) - max(d) FILTER (k = floor(h))) AS threshold
  FROM (SELECT *, greatest(1.0, least(n * 0.75 + 0.5, CAST(n AS DOUBLE))) AS h FROM death)
)"""
BARS = f"{WITH}, {ZSCORES}, {EDGES}, {TREE}"
BOUND = f"""{BINDING}, bd0 AS (SELECT * FROM b WHERE r < {TAU}),
bd AS (SELECT 'all' AS panel_group, * FROM bd0 UNION ALL SELECT s AS panel_group, * FROM bd0)"""
SCORES = f"""tot AS (SELECT panel_group, count(DISTINCT s) AS nf, count(DISTINCT m) AS nh FROM bd GROUP BY 1),
bb AS (SELECT panel_group, p, avg(x) AS binding, count(*) AS hlas FROM (SELECT panel_group, p, m, max(greatest(0.0, 1 - r / {TAU})) AS x FROM bd GROUP BY ALL) GROUP BY ALL),
pf AS (SELECT panel_group, p, count(DISTINCT s) AS files FROM bd GROUP BY ALL),
sc0 AS (SELECT panel_group, p, files, hlas, nf, nh, files / nf AS pc, hlas / nh AS hc, binding FROM pf JOIN bb USING (panel_group, p) JOIN tot USING (panel_group)),
sc AS (
  SELECT panel_group, p, files, hlas, nf, nh, row_number() OVER (PARTITION BY panel_group ORDER BY p) AS ordinal,
  {", ".join(f"CASE WHEN max({c}) OVER g > min({c}) OVER g THEN ({c} - min({c}) OVER g) / (max({c}) OVER g - min({c}) OVER g) ELSE 0.0 END AS {n}" for c, n in (("pc", "x_pc"), ("hc", "x_hc"), ("binding", "x_b")))}
  FROM sc0 WINDOW g AS (PARTITION BY panel_group)
)"""
W = PANEL_WEIGHTS
TOPN = """SELECT locus, allele, {f} AS mean_allele_frequency, num_rows, {w} AS effective_weight, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY locus ORDER BY mf DESC, ew DESC, allele) AS rank FROM (
    SELECT locus, allele, sum(f * w) / sum(w) AS mf, count(*) AS num_rows, sum(w) AS ew FROM panel {where} GROUP BY ALL)) WHERE rank <= 10"""
METRICS = f"""WITH {BINDING}, {PANEL},
hits AS (SELECT m AS allele, count(DISTINCT p) AS c FROM b WHERE r < 2.0 GROUP BY 1),
nm AS (SELECT population, locus, coalesce(c, 0) AS h, CASE WHEN c > 0 THEN 'HLA-' || panel.allele END AS allele, sum(f) AS f FROM panel LEFT JOIN hits ON hits.allele = 'HLA-' || panel.allele GROUP BY ALL),
al AS (SELECT population, locus, h, allele, sum(f) AS f FROM (SELECT * FROM nm UNION ALL SELECT population, locus, 0, NULL, greatest(0, 1 - sum(f)) FROM nm GROUP BY population, locus) GROUP BY ALL),
ml AS (SELECT population, locus, h, f / sum(f) OVER (PARTITION BY population, locus) AS f, row_number() OVER (PARTITION BY population, locus ORDER BY h, allele NULLS FIRST) AS k FROM al),
lp AS (SELECT a.population, a.locus, CASE WHEN a.k = c.k THEN a.h ELSE a.h + c.h END AS h, sum(CASE WHEN a.k = c.k THEN a.f * c.f ELSE 2 * a.f * c.f END) AS p
  FROM ml a JOIN ml c ON a.population = c.population AND a.locus = c.locus AND a.k <= c.k GROUP BY ALL),
pp AS (SELECT a.population, a.h + c.h + e.h AS h, sum(a.p * c.p * e.p) AS p FROM lp a JOIN lp c USING (population) JOIN lp e USING (population) WHERE a.locus = 'A' AND c.locus = 'B' AND e.locus = 'C' GROUP BY ALL),
wt AS (SELECT population, max(w) / sum(max(w)) OVER () AS weight FROM panel GROUP BY population),
mx AS (SELECT h, sum(p * weight) AS p FROM pp JOIN wt USING (population) GROUP BY h)"""
MOMENTS = """{by}{c} AS coverage_percent, {e} AS expected_hits, {m} AS conditional_mean_hits, CAST(coalesce(max(h) FILTER (round(tail, 12) >= 0.9), 0) AS BIGINT) AS pc90"""
_P0 = "greatest(0, 1 - coalesce(sum(p) FILTER (h = 0), 0))"
_MOMENTS = MOMENTS.format(by="", c=r(f"100 * {_P0}"), e=r("sum(h * p)"), m=r(f"CASE WHEN {_P0} > 0 THEN sum(h * p) / {_P0} ELSE 0 END"))


#: The six shifts by rule: what is raised, by how much, what is lowered by equal parts; then the full product, baseline first.
GRID = f"""base AS (SELECT CAST([{", ".join(map(repr, PANEL_WEIGHTS.values()))}] AS DOUBLE[]) AS w),
shift(k, up, gain, down) AS (VALUES (1, 1, 0.08, [3, 6]), (2, 2, 0.08, [5, 6]), (3, 5, 0.06, [6]), (4, 3, 0.1, [1, 4]), (5, 4, 0.1, [5, 6]), (6, 6, 0.1, [1, 5])),
moved AS (SELECT k, [CASE WHEN i = up THEN w[i] + gain WHEN list_contains(down, i) THEN greatest(0.0, w[i] - gain / len(down)) ELSE w[i] END FOR i IN range(1, 7)] AS m FROM shift, base),
wset AS (SELECT 0 AS k, w FROM base UNION ALL SELECT k, [x / list_sum(m) FOR x IN m] FROM moved),
opts AS (
  SELECT pct, thr, most, k, w, row_number() OVER (ORDER BY pct, thr, most, k) AS place FROM (SELECT unnest([65.0, 75.0, 85.0]) AS pct), (SELECT unnest([{TAU}, 40.0]) AS thr), (SELECT unnest([20, 22]) AS most), wset
), g AS (
  SELECT row_number() OVER (ORDER BY NOT (pct = 75 AND thr = {TAU} AND most = 20 AND k = 0), place) - 1 AS run_id, * FROM opts
)"""
#: How many rows are below each run's threshold.
GRID_SQL = f"""WITH {BINDING}, {GRID}, bound AS (SELECT thr AS t, (SELECT count(*) FROM b WHERE r < thr) AS n FROM (SELECT DISTINCT thr FROM g))
SELECT CAST(run_id AS BIGINT) AS run_id, {r("CAST(pct AS DOUBLE)")} AS percentile, {r("CAST(thr AS DOUBLE)")} AS rank_threshold, CAST(most AS BIGINT) AS max_peptides,
{", ".join(f"{r(f'CAST(w[{k + 1}] AS DOUBLE)')} AS w_{n}" for k, n in enumerate(PANEL_WEIGHTS))}, CAST(bound.n AS BIGINT) AS num_binders FROM g JOIN bound ON bound.t = g.thr"""


def _greedy(weights: list[str], most: int = 20, more: str = "") -> str:
    """Panels step by step: items of each group with what they cover; families by the least ordinal that windows pass on."""
    w = dict(zip(PANEL_WEIGHTS, weights))
    return f"""km AS (SELECT DISTINCT p, CASE WHEN length(p) < 7 THEN '#' || p ELSE substr(p, CAST(i AS INT), 7) END AS g FROM (SELECT p, unnest(range(1, greatest(length(p) - 6, 1) + 1)) AS i FROM (SELECT DISTINCT p FROM bd))),
fl AS (
  SELECT 0 AS it, panel_group, p, ordinal AS lab FROM sc
  UNION ALL
  SELECT it + 1, panel_group, p, min(lab) FROM (SELECT it, panel_group, p, min(lab) OVER (PARTITION BY panel_group, g) AS lab FROM fl JOIN km USING (p) WHERE it < 30) GROUP BY it, panel_group, p
), fm AS (SELECT panel_group, p, dense_rank() OVER (PARTITION BY panel_group ORDER BY lab) AS family FROM fl WHERE it = 30),
cv AS (SELECT panel_group, p, list(DISTINCT s) AS fs, list(DISTINCT m) AS hs FROM bd GROUP BY ALL),
kl AS (SELECT p, list(g) AS ks FROM km GROUP BY p),
items{'0' if more else ''} AS (SELECT panel_group, p, ordinal, nf, nh, x_b, x_pc, family, fs, hs, ks FROM sc JOIN fm USING (panel_group, p) JOIN cv USING (panel_group, p) JOIN kl USING (p)),
{more}gr AS (
  SELECT DISTINCT 0 AS step, panel_group, CAST('' AS VARCHAR) AS p, CAST(0 AS BIGINT) AS family, CAST(0 AS DOUBLE) AS pat, CAST(0 AS DOUBLE) AS hla, CAST(0 AS DOUBLE) AS nov, CAST(0 AS DOUBLE) AS red, CAST(0 AS DOUBLE) AS bin, CAST(0 AS DOUBLE) AS prev,
         CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS done_f, CAST(0 AS DOUBLE) AS done_h, CAST([] AS VARCHAR[]) AS cf, CAST([] AS VARCHAR[]) AS ch, CAST([] AS VARCHAR[]) AS ck, CAST([] AS VARCHAR[]) AS cp, CAST([] AS BIGINT[]) AS cm FROM items
  UNION ALL
  SELECT step + 1, panel_group, p, family, pat, hla, nov, red, x_b, x_pc, total, len(list_distinct(list_concat(cf, fs))) / nf, len(list_distinct(list_concat(ch, hs))) / nh,
         list_distinct(list_concat(cf, fs)), list_distinct(list_concat(ch, hs)), list_distinct(list_concat(ck, ks)), list_append(cp, p), list_distinct(list_append(cm, family))
  FROM (
    SELECT *, row_number() OVER (PARTITION BY panel_group ORDER BY round(total, 12) DESC, ordinal) AS place FROM (
      SELECT *, (((({w["patient"]} * pat + {w["hla"]} * hla) + {w["binding"]} * x_b) + {w["prevalence"]} * x_pc) + {w["novelty"]} * nov) - {w["redundancy"]} * red AS total FROM (
        SELECT a.step, a.cf, a.ch, a.ck, a.cp, a.cm, i.*, len(list_filter(i.fs, lambda x: NOT list_contains(a.cf, x))) / i.nf AS pat, len(list_filter(i.hs, lambda x: NOT list_contains(a.ch, x))) / i.nh AS hla,
               CASE WHEN list_contains(a.cm, i.family) THEN 0.0 ELSE 1.0 END AS nov, CASE WHEN list_has_any(a.ck, i.ks) THEN 1.0 ELSE 0.0 END AS red
        FROM gr a JOIN items i ON i.panel_group = a.panel_group WHERE a.step < {most} AND NOT list_contains(a.cp, i.p)
      )
    )
  ) WHERE place = 1
)"""


GREEDY = _greedy([repr(x) for x in W.values()])
GREEDY_SQL = f"""WITH RECURSIVE {BOUND}, {SCORES}, {GREEDY} SELECT panel_group, CAST(step AS BIGINT) AS step, p AS peptide, family AS family_id, {r("pat")} AS incremental_patient_coverage, {r("hla")} AS incremental_hla_coverage,
{r("nov")} AS family_novelty_score, {r("red")} AS redundancy_penalty, {r(f"{W['patient']} * pat")} AS patient_term, {r(f"{W['hla']} * hla")} AS hla_term, {r(f"{W['binding']} * bin")} AS binding_term, {r(f"{W['prevalence']} * prev")} AS prevalence_term,
{r(f"{W['novelty']} * nov")} AS family_novelty_term, {r(f"{W['redundancy']} * red")} AS redundancy_term, {r("total")} AS total_score, {r("done_f")} AS cumulative_patient_coverage, {r("done_h")} AS cumulative_hla_coverage,
CAST(len(cm) AS BIGINT) AS num_families_represented FROM gr WHERE step > 0"""
PANEL_SETS = "t AS (SELECT panel_group, list(p) AS ps FROM gr WHERE step > 0 GROUP BY panel_group)"
JACCARD = "len(list_intersect(t.ps, q.ps)) / len(list_distinct(list_concat(t.ps, q.ps)))"
JACCARD_SQL = f"""WITH RECURSIVE {BOUND}, {SCORES}, {GREEDY}, {PANEL_SETS} SELECT t.panel_group AS panel_group, {r(JACCARD)} AS jaccard, list_sort(t.ps) = list_sort(q.ps) AS exact FROM t, (SELECT ps FROM t WHERE panel_group = 'all') q"""
#: Clusters at three percentiles, the panels of the cohort and of each cluster, and their unions compared with the middle one's.
SWEEP_SQL = f"""{BARS}, ths AS (
  SELECT pct, max(d) FILTER (k = floor(h)) + max(h - floor(h)) * (max(d) FILTER (k = least(floor(h) + 1, n)) - max(d) FILTER (k = floor(h))) AS threshold
  FROM (SELECT *, greatest(1.0, least(n * pct / 100 + 0.5, CAST(n AS DOUBLE))) AS h FROM death, (SELECT unnest([65.0, 75.0, 85.0]) AS pct)) GROUP BY pct
), cl AS (SELECT pct, i, dense_rank() OVER (PARTITION BY pct ORDER BY min(j)) AS label FROM (SELECT pct, i, j FROM mm, ths WHERE d <= threshold UNION SELECT pct, i, i FROM es, ths) GROUP BY pct, i),
nm AS (SELECT DISTINCT i, s FROM z),
bd AS (
  SELECT pct || ':' || label AS panel_group, b.* FROM b JOIN nm ON nm.s = b.s JOIN cl ON cl.i = nm.i WHERE r < {TAU}
  UNION ALL SELECT pct || ':0', b.* FROM b, ths WHERE r < {TAU}
), {SCORES}, {GREEDY},
t AS (SELECT CAST(split_part(panel_group, ':', 1) AS DOUBLE) AS pct, list(DISTINCT p) AS ps FROM gr WHERE step > 0 GROUP BY 1),
ng AS (SELECT pct, count(DISTINCT label) AS groups FROM cl GROUP BY pct),
ag AS (SELECT a.pct, avg(CASE WHEN a.label = c.label THEN 1.0 ELSE 0.0 END) AS same FROM cl a JOIN cl c ON c.i = a.i AND c.pct = 75 GROUP BY a.pct)
SELECT CASE t.pct WHEN 75 THEN 0 WHEN 65 THEN 1 ELSE 2 END::BIGINT AS run_id, CASE t.pct WHEN 75 THEN 'baseline' WHEN 65 THEN 'percentile 65.00' ELSE 'percentile 85.00' END AS label, {r("t.pct")} AS percentile, {r(f"CAST({TAU} AS DOUBLE)")} AS rank_threshold,
CAST(20 AS BIGINT) AS max_peptides, ng.groups AS num_groups, ng.groups = n0.groups AS same_num_groups, ag.same = 1 AS assignment_exact_match, {r("ag.same")} AS assignment_agreement, CAST(len(t.ps) AS BIGINT) AS num_selected_peptides,
{r(JACCARD)} AS peptide_jaccard, list_sort(t.ps) = list_sort(q.ps) AS peptide_set_exact_match, ng.groups = n0.groups AND {JACCARD} >= 0.8 AS stable_overall
FROM t JOIN ng USING (pct) JOIN ag USING (pct), (SELECT ps FROM t WHERE pct = 75) q, (SELECT groups FROM ng WHERE pct = 75) n0"""
#: All 84 runs: scores for each percentile and threshold, panels for each set of weights, of 22 peptides of which 20 are the beginning.
SWEEP_FULL_SQL = f"""{BARS}, {GRID}, ths AS (
  SELECT pct, max(d) FILTER (k = floor(h)) + max(h - floor(h)) * (max(d) FILTER (k = least(floor(h) + 1, n)) - max(d) FILTER (k = floor(h))) AS threshold
  FROM (SELECT *, greatest(1.0, least(n * pct / 100 + 0.5, CAST(n AS DOUBLE))) AS h FROM death, (SELECT DISTINCT CAST(pct AS DOUBLE) AS pct FROM g)) GROUP BY pct
), cl AS (SELECT pct, i, dense_rank() OVER (PARTITION BY pct ORDER BY min(j)) AS label FROM (SELECT pct, i, j FROM mm, ths WHERE d <= threshold UNION SELECT pct, i, i FROM es, ths) GROUP BY pct, i),
nm AS (SELECT DISTINCT i, s FROM z), thr AS (SELECT DISTINCT CAST(thr AS DOUBLE) AS thr FROM g),
bd AS (
  SELECT pct || ':' || thr || ':' || label AS panel_group, b.*, thr FROM b JOIN nm ON nm.s = b.s JOIN cl ON cl.i = nm.i, thr WHERE r < thr
  UNION ALL SELECT pct || ':' || thr || ':0', b.*, thr FROM b, ths, thr WHERE r < thr
), {SCORES.replace(f"1 - r / {TAU}", "1 - r / thr")},
{_greedy([f"w[{k}]" for k in range(1, 7)], 22, "items AS (SELECT items0.* REPLACE (panel_group || ':' || k AS panel_group), w FROM items0, wset)," + chr(10))},
t AS (
  SELECT run_id, list(DISTINCT p) AS ps FROM g JOIN gr ON CAST(split_part(panel_group, ':', 1) AS DOUBLE) = pct AND CAST(split_part(panel_group, ':', 2) AS DOUBLE) = thr AND CAST(split_part(panel_group, ':', 4) AS INT) = g.k AND step BETWEEN 1 AND most GROUP BY run_id
), ng AS (SELECT pct, count(DISTINCT label) AS groups FROM cl GROUP BY pct),
ag AS (SELECT a.pct, avg(CASE WHEN a.label = c.label THEN 1.0 ELSE 0.0 END) AS same FROM cl a JOIN cl c ON c.i = a.i AND c.pct = 75 GROUP BY a.pct),
su AS (
  SELECT run_id, ng.groups = n0.groups AS alike, ag.same = 1 AS exact, {JACCARD} AS jaccard, list_sort(t.ps) = list_sort(q.ps) AS whole FROM t JOIN g USING (run_id) JOIN ng ON ng.pct = g.pct JOIN ag ON ag.pct = g.pct, (SELECT ps FROM t WHERE run_id = 0) q, (SELECT groups FROM ng WHERE pct = 75) n0
)
SELECT count(*) AS num_runs, count(*) FILTER (alike AND (jaccard >= 0.8 OR whole)) AS num_stable, {r("avg(CASE WHEN alike AND (jaccard >= 0.8 OR whole) THEN 1.0 ELSE 0.0 END)")} AS fraction_stable_overall, {r("avg(CASE WHEN alike THEN 1.0 ELSE 0.0 END)")} AS fraction_same_num_groups,
{r("avg(CASE WHEN exact THEN 1.0 ELSE 0.0 END)")} AS fraction_assignment_exact_match, {r("avg(CASE WHEN whole THEN 1.0 ELSE 0.0 END)")} AS fraction_peptide_set_exact_match, {r("avg(jaccard)")} AS mean_peptide_jaccard FROM su"""
#: Panels of the cohort and of each cluster; every group meets every population, which the mixture weighs.
SUITE_METRICS_SQL = f"""{BARS}, {PCT}, cl AS (SELECT i, dense_rank() OVER (ORDER BY min(j)) AS label FROM (SELECT i, j FROM mm, pct WHERE d <= threshold UNION SELECT i, i FROM es) GROUP BY i),
{PANEL}, nm AS (SELECT DISTINCT i, s FROM z),
bd AS (SELECT 'honest:' || label AS panel_group, b.* FROM b JOIN nm ON nm.s = b.s JOIN cl ON cl.i = nm.i WHERE r < {TAU} UNION ALL SELECT 'global:0', b.* FROM b JOIN nm ON nm.s = b.s WHERE r < {TAU}),
{SCORES}, {GREEDY},
ht AS (SELECT panel_group, m AS allele, count(DISTINCT bd.p) AS c FROM bd JOIN (SELECT panel_group, p FROM gr WHERE step > 0) USING (panel_group, p) GROUP BY ALL),
gs AS (SELECT panel_group, count(*) AS alleles FROM ht GROUP BY 1),
na AS (SELECT gs.panel_group, population, locus, coalesce(c, 0) AS h, CASE WHEN c > 0 THEN panel.allele END AS allele, sum(f) AS f FROM panel CROSS JOIN gs LEFT JOIN ht ON ht.panel_group = gs.panel_group AND ht.allele = 'HLA-' || panel.allele GROUP BY ALL),
al AS (SELECT panel_group, population, locus, h, allele, sum(f) AS f FROM (SELECT * FROM na UNION ALL SELECT panel_group, population, locus, 0, NULL, greatest(0, 1 - sum(f)) FROM na GROUP BY panel_group, population, locus) GROUP BY ALL),
ml AS (SELECT panel_group, population, locus, h, f / sum(f) OVER (PARTITION BY panel_group, population, locus) AS f, row_number() OVER (PARTITION BY panel_group, population, locus ORDER BY h, allele NULLS FIRST) AS k FROM al),
lp AS (SELECT a.panel_group, a.population, a.locus, CASE WHEN a.k = c.k THEN a.h ELSE a.h + c.h END AS h, sum(CASE WHEN a.k = c.k THEN a.f * c.f ELSE 2 * a.f * c.f END) AS p
  FROM ml a JOIN ml c ON a.panel_group = c.panel_group AND a.population = c.population AND a.locus = c.locus AND a.k <= c.k GROUP BY ALL),
pp AS (SELECT panel_group, population, a.h + c.h + e.h AS h, sum(a.p * c.p * e.p) AS p FROM lp a JOIN lp c USING (panel_group, population) JOIN lp e USING (panel_group, population) WHERE a.locus = 'A' AND c.locus = 'B' AND e.locus = 'C' GROUP BY ALL),
wt AS (SELECT population, max(w) / sum(max(w)) OVER () AS weight FROM panel GROUP BY population),
mx AS (SELECT panel_group, h, sum(p * weight) AS p FROM pp JOIN wt USING (population) GROUP BY panel_group, h),
tl AS (SELECT *, sum(p) OVER (PARTITION BY panel_group ORDER BY h DESC) AS tail FROM mx),
mo AS (SELECT panel_group, {_MOMENTS} FROM tl GROUP BY panel_group),
fc AS (SELECT panel_group, count(*) AS files FROM (SELECT 'honest:' || label AS panel_group FROM cl UNION ALL SELECT 'global:0' FROM cl) GROUP BY 1),
pc AS (SELECT panel_group, count(*) AS picks FROM gr WHERE step > 0 GROUP BY 1),
md(mode, base, name) AS (VALUES ('global', 'global', 'Global cohort'), ('honest', 'honest', 'Honest raw Group '), ('practical', 'honest', 'Practical Group '))
SELECT mode, CAST(split_part(panel_group, ':', 2) AS BIGINT) AS "group", CASE WHEN mode = 'global' THEN name ELSE name || split_part(panel_group, ':', 2) END AS label, files AS num_files, picks AS num_selected_peptides,
alleles AS num_hit_hlas, (SELECT count(DISTINCT population) FROM panel) AS num_reference_populations, coverage_percent, expected_hits, conditional_mean_hits, pc90
FROM gs JOIN mo USING (panel_group) JOIN fc USING (panel_group) JOIN pc USING (panel_group) JOIN md ON md.base = split_part(panel_group, ':', 1)"""


def _repair(name: str, start: str, low: int, high: int = 20) -> str:
    """Groups after the smallest one below ``low`` has joined its best neighbour again and again. ``took`` marks the members
    that a step moved, ``hit`` those that any step has; ``score`` is what the step chose by."""
    fits = f"size_g + size_c - greatest({low}, least(size_g + size_c, {high}))"
    return f"""{name} AS (
  SELECT 0 AS it, i, label, 0 AS hit, 0 AS took, CAST(NULL AS DOUBLE) AS score FROM {start}
  UNION ALL
  SELECT it + 1, i, CAST(dense_rank() OVER (ORDER BY first) AS INT), hit, took, score FROM (
    SELECT it, i, hit, took, score, min(i) OVER (PARTITION BY joined) AS first FROM (
      SELECT x.it, x.i, CASE WHEN x.label = b.g THEN b.c ELSE x.label END AS joined, CASE WHEN x.label = b.g THEN 1 ELSE x.hit END AS hit, CASE WHEN x.label = b.g THEN 1 ELSE 0 END AS took, b.score
      FROM {name} x, (
        SELECT g, c, CASE WHEN size_g + size_c > {high} THEN apart ELSE apart + 1e-6 * abs({fits}) END AS score FROM (
          SELECT sm.g AS g, y.label AS c, any_value(sm.n) AS size_g, count(DISTINCT y.i) AS size_c, avg(es.d) AS apart
          FROM (SELECT label AS g, count(*) AS n FROM {name} GROUP BY label HAVING count(*) < {low} ORDER BY count(*), label LIMIT 1) sm
          JOIN {name} x ON x.label = sm.g JOIN {name} y ON y.label <> sm.g JOIN es ON es.i = x.i AND es.j = y.i GROUP BY sm.g, y.label
        ) ORDER BY size_g + size_c > {high}, score, c LIMIT 1
      ) b
    )
  )
)"""


#: Raw clusters as first groups, singletons joined, then what is below three. No group here is above twenty, so none is split.
GROUPING = f"""rc AS (SELECT i, CAST(dense_rank() OVER (ORDER BY min(j)) AS INT) AS label FROM (SELECT i, j FROM mm, pct WHERE d <= threshold UNION SELECT i, i FROM es) GROUP BY i),
{_repair("ra", "rc", 2)}, rb0 AS (SELECT i, label FROM ra WHERE it = (SELECT max(it) FROM ra)), {_repair("rb", "rb0", 3)},
gm AS (
  SELECT rc.i AS i, rc.label AS raw, rb.label AS label, a.hit AS merged, rb.hit AS repaired, nm.s AS s
  FROM rc JOIN rb ON rb.i = rc.i AND rb.it = (SELECT max(it) FROM rb) JOIN (SELECT i, max(hit) AS hit FROM ra GROUP BY i) a ON a.i = rc.i JOIN (SELECT DISTINCT i, s FROM z) nm ON nm.i = rc.i
)"""
GROUPS_SQL = f"""{BARS}, {PCT}, {GROUPING} SELECT CAST(i AS INT) AS sample_idx, s AS id, raw AS raw_cluster, raw AS initial_group, label AS practical_group, raw <> label AS moved,
CASE WHEN merged + repaired = 0 THEN 'unchanged' ELSE concat_ws(';', CASE WHEN merged = 1 THEN 'merge_small_group:merge' END, CASE WHEN repaired = 1 THEN 'repair_small_group:merge' END) END AS reason_code FROM gm"""
AUDIT_SUMMARY_SQL = f"""{BARS}, {PCT}, {GROUPING}, ns AS (SELECT (SELECT max(it) FROM ra) AS a, (SELECT max(it) FROM rb) AS b)
SELECT a + b + 2 AS num_events, a + b AS num_merges, 0 AS num_splits, b AS num_repair_steps, 0 AS num_relabels, 3 AS min_size, 20 AS max_size, (SELECT count(*) FROM gm WHERE raw <> label) AS num_files_changed,
(SELECT string_agg(n, ';' ORDER BY label) FROM (SELECT label, count(*) AS n FROM gm GROUP BY label)) AS final_sizes FROM ns"""
#: Every step with what it moved: the first groups, steps of either repair, the last groups.
AUDIT_SQL = f"""{BARS}, {PCT}, {GROUPING},
trail AS (
  SELECT 1 AS step, 'initial' AS stage, 'noop' AS action, 3 AS low, i, label AS before, label AS after, 1 AS took, CAST(NULL AS DOUBLE) AS score FROM rc
  UNION ALL SELECT y.it + 1, 'merge_small_group', 'merge', 2, y.i, x.label, y.label, y.took, y.score FROM ra x JOIN ra y ON y.i = x.i AND y.it = x.it + 1
  UNION ALL SELECT (SELECT max(it) FROM ra) + y.it + 1, 'repair_small_group', 'merge', 3, y.i, x.label, y.label, y.took, y.score FROM rb x JOIN rb y ON y.i = x.i AND y.it = x.it + 1
  UNION ALL SELECT (SELECT max(it) FROM ra) + (SELECT max(it) FROM rb) + 2, 'final', 'noop', 3, i, label, label, 1, NULL FROM rb WHERE it = (SELECT max(it) FROM rb)
),
heads AS (SELECT step, any_value(stage) AS stage, any_value(action) AS action, any_value(low) AS low, max(score) AS score FROM trail GROUP BY step),
whom AS (
  SELECT step, string_agg(trail.i, ';' ORDER BY trail.i) AS affected, string_agg(gm.s, ';' ORDER BY trail.i) AS affected_ids FROM trail JOIN gm USING (i) WHERE took = 1 GROUP BY step
), named AS (
  SELECT step, kind, string_agg(x, ';' ORDER BY first) AS names FROM (
    SELECT step, 'raw' AS kind, gm.raw AS x, min(trail.i) AS first FROM trail JOIN gm USING (i) WHERE took = 1 GROUP BY ALL
    UNION ALL SELECT step, 'before', before, min(i) FROM trail WHERE took = 1 GROUP BY ALL UNION ALL SELECT step, 'after', after, min(i) FROM trail WHERE took = 1 GROUP BY ALL
  ) GROUP BY step, kind
), sized AS (
  SELECT step, kind, string_agg(n, ';' ORDER BY x) AS sizes FROM (
    SELECT step, 'before' AS kind, before AS x, count(*) AS n FROM trail GROUP BY ALL UNION ALL SELECT step, 'after', after, count(*) FROM trail GROUP BY ALL
  ) GROUP BY step, kind
)
SELECT heads.step::BIGINT AS step, stage, action, a.names AS raw_groups, b.names AS groups_before, c.names AS groups_after, affected, affected_ids, d.sizes AS sizes_before, e.sizes AS sizes_after,
{r("score")} AS distance_evidence, CAST(low AS BIGINT) AS min_size, CAST(20 AS BIGINT) AS max_size
FROM heads JOIN whom USING (step) JOIN named a ON a.step = heads.step AND a.kind = 'raw' JOIN named b ON b.step = heads.step AND b.kind = 'before' JOIN named c ON c.step = heads.step AND c.kind = 'after'
JOIN sized d ON d.step = heads.step AND d.kind = 'before' JOIN sized e ON e.step = heads.step AND e.kind = 'after'"""
#: The panels of all three modes and what each mode, and all of them, take in first.
UNIONS_SQL = f"""{BARS}, {PCT}, {GROUPING},
bd AS (
  SELECT 'global:0' AS panel_group, b.* FROM b WHERE r < {TAU} UNION ALL SELECT 'honest:' || raw, b.* FROM b JOIN gm ON gm.s = b.s WHERE r < {TAU} UNION ALL SELECT 'practical:' || label, b.* FROM b JOIN gm ON gm.s = b.s WHERE r < {TAU}
), {SCORES}, {GREEDY},
hs AS (SELECT split_part(panel_group, ':', 1) AS mode, CAST(split_part(panel_group, ':', 2) AS INT) AS grp, step, p FROM gr WHERE step > 0),
fs AS (SELECT mode, p, min((CASE mode0 WHEN 'global' THEN 0 WHEN 'honest' THEN 1 ELSE 2 END, grp, step)) AS first FROM (SELECT mode, mode AS mode0, grp, step, p FROM hs UNION ALL SELECT 'all', mode, grp, step, p FROM hs) GROUP BY mode, p)
SELECT mode, CAST(row_number() OVER (PARTITION BY mode ORDER BY first, p) AS INT) AS ordinal, p AS peptide FROM fs"""
#: What each death joins: the samples that shorter ways reach from either end of its edge.
MERGES_SQL = f"""{BARS}, ev AS (SELECT es.i, es.j, es.d, row_number() OVER (ORDER BY es.d, es.i, es.j) AS step FROM es JOIN mm USING (i, j) WHERE es.i < es.j AND es.d = mm.d),
le AS (SELECT step, list_sort(list_distinct(list_append(list(mm.j) FILTER (mm.d < ev.d), ev.i))) AS a FROM ev JOIN mm ON mm.i = ev.i GROUP BY step, ev.i),
ri AS (SELECT step, list_sort(list_distinct(list_append(list(mm.j) FILTER (mm.d < ev.d), ev.j))) AS c FROM ev JOIN mm ON mm.i = ev.j GROUP BY step, ev.j)
SELECT step, {r("d")} AS epsilon, array_to_string(a, ';') AS "left", array_to_string(c, ';') AS "right", array_to_string(list_sort(list_concat(a, c)), ';') AS merged FROM ev JOIN le USING (step) JOIN ri USING (step)"""
#: The tree grown from the first vector, the nearest outside next; its lengths are the deaths.
EMBEDDING_BARCODE_SQL = f"""WITH RECURSIVE lg AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
sd AS (SELECT pos, avg(x) AS mu, stddev_samp(x) AS sd FROM lg GROUP BY pos),
z AS (SELECT row_number() OVER (ORDER BY vec_id) AS i, v FROM (SELECT vec_id, list(CASE WHEN sd > 0 THEN (x - mu) / sd ELSE 0 END ORDER BY pos) AS v FROM lg JOIN sd USING (pos) GROUP BY vec_id)),
m AS MATERIALIZED (SELECT a.i AS i, list(list_distance(a.v, c.v) ORDER BY c.i) AS ds FROM z a, z c GROUP BY a.i),
pr AS (
  SELECT 1 AS step, CAST(1 AS BIGINT) AS cur, [CASE WHEN x = 1 THEN NULL ELSE CAST('Infinity' AS DOUBLE) END FOR x IN range(1, (SELECT count(*) FROM z) + 1)] AS best, CAST(NULL AS DOUBLE) AS death
  UNION ALL
  SELECT step + 1, list_position(near, list_min(near)), [CASE WHEN x = list_position(near, list_min(near)) THEN NULL ELSE near[x] END FOR x IN range(1, len(near) + 1)], list_min(near)
  FROM (SELECT step, [CASE WHEN best[x] IS NULL THEN NULL ELSE least(best[x], ds[x]) END FOR x IN range(1, len(best) + 1)] AS near FROM pr JOIN m ON m.i = pr.cur) WHERE list_min(near) IS NOT NULL
)
SELECT row_number() OVER (ORDER BY death) AS bar, CAST(0 AS DOUBLE) AS birth, {r("death")} AS death FROM pr WHERE death IS NOT NULL UNION ALL SELECT count(*), CAST(0 AS DOUBLE), CAST('Infinity' AS DOUBLE) FROM z"""


def _component(name: str, start: str) -> str:
    """The first eigenvector of the symmetric matrix ``start`` (r, q, x): the matrix is squared again and again, until its columns
    are multiples of it; of its entries the largest is positive."""
    return f"""{name}m AS (
  SELECT 0 AS it, r, q, x FROM {start}
  UNION ALL
  SELECT it + 1, r, q, x / max(abs(x)) OVER () FROM (SELECT a.it AS it, a.r AS r, c.q AS q, sum(a.x * c.x) AS x FROM {name}m a JOIN {name}m c ON c.it = a.it AND c.r = a.q WHERE a.it < 16 GROUP BY a.it, a.r, c.q)
), {name} AS (
  SELECT r AS pos, x / sqrt(sum(x * x) OVER ()) * sign(max_by(x, abs(x)) OVER ()) AS x FROM {name}m
  WHERE it = 16 AND q = (SELECT max_by(r, x) FROM {name}m WHERE it = 16 AND r = q)
)"""


#: Two components of the weighted features, the second of what the first leaves.
PCA_SQL = f"""{WITH}, {ZSCORES}, {EDGES},
cw AS (SELECT i, pos, v - avg(v) OVER (PARTITION BY pos) AS v FROM w),
c1 AS (SELECT a.pos AS r, c.pos AS q, sum(a.v * c.v) AS x FROM cw a JOIN cw c ON c.i = a.i GROUP BY ALL), {_component("p1", "c1")},
l1 AS (SELECT sum(a.x * c1.x * c.x) AS l FROM c1 JOIN p1 a ON a.pos = c1.r JOIN p1 c ON c.pos = c1.q),
c2 AS (SELECT r, q, c1.x - l * a.x * c.x AS x FROM c1 JOIN p1 a ON a.pos = c1.r JOIN p1 c ON c.pos = c1.q, l1), {_component("p2", "c2")}
SELECT CAST(i AS BIGINT) AS sample_idx, {r("sum(cw.v * p1.x)")} AS pc1, {r("sum(cw.v * p2.x)")} AS pc2 FROM cw JOIN p1 ON p1.pos = cw.pos JOIN p2 ON p2.pos = cw.pos GROUP BY i"""


ORACLES = {
    "binders": f"WITH {BINDING} SELECT s AS identity, p AS peptide, m AS mhc, {r('r')} AS rank_el FROM b WHERE r < {TAU}",
    "hla_filtered_rows": f"""WITH {BINDING}, {PANEL}, t AS ({TOPN.format(f="mf", w="ew", where="")})
SELECT s AS identity, m AS mhc, count(*) AS n, {r("min(r)")} AS best FROM b WHERE m IN (SELECT 'HLA-' || allele FROM t WHERE rank <= 3) GROUP BY ALL""",
    "sample_basic_counts": _part("basic"),
    "sample_rank_stats": _part("ranks"),
    "sample_top_ranks": _part("top"),
    "sample_promiscuity": _part("promiscuity"),
    "sample_entropy": _part("entropy"),
    "peptide_kmers": f"WITH {BINDING}, {KMERS} SELECT p AS peptide, g AS kmer FROM k",
    "kmer_overlap_pairs": f"WITH {BINDING}, {KMERS} SELECT DISTINCT a.p AS a, c.p AS b FROM k a JOIN k c USING (g) WHERE a.p < c.p",
    "peptide_families": f"{WITH} SELECT s AS sample, p AS peptide, family FROM fam",
    "sample_family_stats": _part("family", WITH),
    "sample_features": f"{WITH} SELECT {_columns(*_PARTS)} FROM {_ALL}",
    "feature_zscores": f"{WITH}, {ZSCORES} SELECT s AS sample, CAST(pos AS BIGINT) AS pos, {r('z')} AS z FROM z",
    "sample_distances": f"{WITH}, {ZSCORES}, {EDGES} SELECT i, j, {r('d')} AS d FROM e WHERE i < j",
    "sample_distances_seuclidean": f"""{WITH}, {ZSCORES}, {EDGES}, u AS (SELECT pos, stddev_samp(v) AS spread FROM w GROUP BY pos),
q AS (SELECT i, pos, CASE WHEN spread > 0 THEN v / spread ELSE 0 END AS v FROM w JOIN u USING (pos))
SELECT a.i AS i, c.i AS j, {r("sqrt(sum((a.v - c.v) * (a.v - c.v)))")} AS d FROM q a JOIN q c ON a.pos = c.pos AND a.i < c.i GROUP BY a.i, c.i""",
    "sample_distances_correlation": f"""{WITH}, {ZSCORES}, {EDGES}
SELECT a.i AS i, c.i AS j, {r("1 - corr(a.v, c.v)")} AS d FROM w a JOIN w c ON a.pos = c.pos AND a.i < c.i GROUP BY a.i, c.i""",
    "embedding_distances_spearman": f"""{EMBEDDED}, k AS (SELECT i, pos, rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2 AS v FROM e),
l AS (SELECT i, list(v - 0.5 - n / 2 ORDER BY pos) AS v FROM (SELECT *, count(*) OVER (PARTITION BY i) AS n FROM k) GROUP BY i)
SELECT a.i AS i, c.i AS j, {r("1 - list_cosine_similarity(a.v, c.v)")} AS d FROM l a JOIN l c ON a.i < c.i""",
    "embedding_distances_minkowski": f"""{EMBEDDED} SELECT a.i AS i, c.i AS j, {r("pow(sum(pow(abs(a.v - c.v), 3)), 1 / 3)")} AS d
FROM e a JOIN e c ON a.pos = c.pos AND a.i < c.i GROUP BY a.i, c.i""",
    "embedding_distances": f"""{EMBEDDED}, z AS (SELECT i, list(v ORDER BY pos) AS v FROM e GROUP BY i)
SELECT a.i AS i, c.i AS j, {r("list_distance(a.v, c.v)")} AS d FROM z a JOIN z c ON a.i < c.i""",
    "h0_barcode": f"{BARS} SELECT k AS bar, CAST(0 AS DOUBLE) AS birth, {r('d')} AS death FROM death UNION ALL SELECT count(*) + 1, CAST(0 AS DOUBLE), CAST('Infinity' AS DOUBLE) FROM death",
    "h0_threshold_pct": f"{BARS}, {PCT} SELECT {r('threshold')} AS threshold FROM pct",
    "h0_threshold_gap": f"{BARS} SELECT {r('d')} AS threshold FROM (SELECT d, k, coalesce(lead(d) OVER (ORDER BY d) - d, -1) AS gap FROM death) ORDER BY gap DESC, k LIMIT 1",
    "raw_clusters": f"""{BARS}, {PCT}, cl AS (SELECT i, min(j) AS root FROM (SELECT i, j FROM mm, pct WHERE d <= threshold UNION SELECT i, i FROM es) GROUP BY i)
SELECT i AS sample_idx, s AS sample, dense_rank() OVER (ORDER BY root) AS raw_cluster FROM cl JOIN (SELECT DISTINCT i, s FROM z) USING (i)""",
    "peptide_scores": f"""WITH {BOUND}, {SCORES} SELECT panel_group, p AS peptide, {r("x_pc")} AS static_patient_coverage, {r("x_hc")} AS static_hla_coverage,
{r("x_b")} AS binding_score, {r("x_pc")} AS prevalence_score, CAST(ordinal AS BIGINT) AS ordinal FROM sc""",
    "greedy_first_pick": f"""WITH {BOUND}, {SCORES}, t AS (SELECT panel_group, p, ordinal, round({W["patient"]} * files / nf + {W["hla"]} * hlas / nh + {W["binding"]} * x_b + {W["prevalence"]} * x_pc + {W["novelty"]}, 9) AS x FROM sc)
SELECT panel_group, p AS peptide, {r("x")} AS total_score FROM (SELECT *, row_number() OVER (PARTITION BY panel_group ORDER BY x DESC, ordinal) AS k FROM t) WHERE k = 1""",
    "greedy_panel": GREEDY_SQL,
    "panel_jaccard": JACCARD_SQL,
    "suite_population_metrics": SUITE_METRICS_SQL,
    "practical_groups": GROUPS_SQL,
    "grouping_audit": AUDIT_SQL,
    "grouping_audit_summary": AUDIT_SUMMARY_SQL,
    "suite_unions": UNIONS_SQL,
    "merge_events": MERGES_SQL,
    "embedding_barcode": EMBEDDING_BARCODE_SQL,
    "robustness_fast": SWEEP_SQL,
    "robustness_full": SWEEP_FULL_SQL,
    "allele_panel_global": f"WITH {PANEL} {TOPN.format(f=r('mf'), w=r('ew'), where='')}",
    "allele_panel_region": f"WITH {PANEL} " + TOPN.format(f=r("mf"), w=r("ew"), where="WHERE lower(trim(region)) = 'europe'"),
    "locus_hit_pmf": f"{METRICS} SELECT population, locus, CAST(h AS BIGINT) AS h, {r('p + 1e-12', 9)} AS p FROM lp",
    "population_hit_pmf": f"{METRICS} SELECT population, CAST(h AS BIGINT) AS h, {r('p + 1e-12', 9)} AS p FROM pp",
    "population_metrics": f"""{METRICS}, tl AS (SELECT *, sum(p) OVER (PARTITION BY population ORDER BY h DESC) AS tail FROM pp)
SELECT population, {r("any_value(weight)")} AS weight, {_MOMENTS} FROM tl JOIN wt USING (population) GROUP BY population""",
    "mixture_metrics": f"{METRICS}, tl AS (SELECT *, sum(p) OVER (ORDER BY h DESC) AS tail FROM mx) SELECT {_MOMENTS} FROM tl",
    "robustness_grid": GRID_SQL,
    "sample_feature_pca": PCA_SQL,
}

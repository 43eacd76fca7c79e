"""The same results as plain SQL over the test tables, for comparison with the queries."""

from __future__ import annotations

from manyvote.plans.catalog import (
    BOOST_DEPTH,
    BOOST_ROUNDS,
    FOLD_SEEDS,
    FRACTION,
    LEVEL_METHODS,
    MIXED_BAGS,
    MIXED_METHODS,
    PARTS,
    SEED,
    SPLIT,
)

LINE_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER), CAST(l_extendedprice AS DECIMAL(12,2)))"
)
FLAG = "CASE l_returnflag WHEN 'A' THEN 0.0 WHEN 'N' THEN 1.0 ELSE 2.0 END"
FLAG_RULES = [
    "CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END",
    "CASE WHEN l_discount > 0.05::DOUBLE THEN 2.0 WHEN l_discount > 0.02::DOUBLE THEN 1.0 ELSE 0.0 END",
    "CASE WHEN l_tax > 0.04::DOUBLE THEN 2.0 ELSE 1.0 END",
    "CASE WHEN l_extendedprice > 50000 THEN 2.0 ELSE 0.0 END",
    "l_linenumber % 3",
]
PRICE_RULES = [
    "1000.0",
    "900 + p_partkey * 0.1::DOUBLE",
    "900 + p_size * 4.0::DOUBLE",
    "950 + (p_partkey % 1000) * 0.1::DOUBLE",
]


def _long(rules: list[str], key: str, label: str, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key} AS row_id, CAST({label} AS DOUBLE) AS label, {i} AS member, CAST({rule} AS DOUBLE) AS prediction"
        f" FROM {table}"
        for i, rule in enumerate(rules)
    )


FLAG_LONG = _long(FLAG_RULES, LINE_KEY, FLAG, "lineitem")
PRICE_LONG = _long(PRICE_RULES, "p_partkey", "p_retailprice", "part")

# Consumes long(row_id, label, member, prediction).
VOTE = """
SELECT row_id, label, prediction AS "baggingPrediction" FROM (
  SELECT row_id, label, prediction,
         row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, prediction) AS place
  FROM long GROUP BY row_id, label, prediction) WHERE place = 1
"""
MEAN = 'SELECT row_id, label, round(avg(prediction), 6) AS "baggingPrediction" FROM long GROUP BY row_id, label'
ACCURACY = "SELECT member, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS value FROM long GROUP BY member"
PRECISION = """
SELECT a.member, sum(a.n * coalesce(a.hits / p.n, 0)) / sum(a.n) AS value
FROM (SELECT member, label, count(*) AS n, CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) AS hits
      FROM long GROUP BY member, label) a
LEFT JOIN (SELECT member, prediction, count(*) AS n FROM long GROUP BY member, prediction) p
  ON p.member = a.member AND p.prediction = a.label
GROUP BY a.member
"""
ERRORS = """
SELECT member, sqrt(avg((label - prediction) ** 2)) AS rmse, avg((label - prediction) ** 2) AS mse,
       1 - avg((label - prediction) ** 2) / var_pop(label) AS r2, avg(abs(label - prediction)) AS mae
FROM long GROUP BY member
"""


def _code(column: str, table: str, order: str = "count(*) DESC, {c}") -> str:
    """A subquery ``value, code`` that numbers the values of a column."""
    order = order.format(c=column)
    return (
        f"(SELECT {column} AS value, CAST(row_number() OVER (ORDER BY {order}) - 1 AS DOUBLE) AS code"
        f" FROM {table} GROUP BY {column})"
    )


def _mark(share: float) -> str:
    return f"{int(share * 2**32):08x}"


def _is_train(seed: int = SEED, key: str = "row_id") -> str:
    share = SPLIT[0] / sum(SPLIT)
    return f"substr(md5(concat_ws(':', 'split', '{seed}', {key})), 1, 8) < '{_mark(share)}'"


def _outside_part(part: int, parts: int, key: str = "row_id") -> str:
    """The train side of one fold of ``parts`` even ones."""
    draw = f"CAST('0x' || substr(md5(concat_ws(':', 'split', '{SEED}', {key})), 1, 8) AS BIGINT)"
    return f"({draw} * {parts} // {2**32} <> {part})"


def _bag_draw(key: str = "row_id") -> str:
    return f"substr(md5(concat_ws(':', 'bag', '{SEED}', bag // 4, {key})), CAST(8 * (bag % 4) + 1 AS INTEGER), 8)"


def _bags(source: str, bags: int, fraction: float = FRACTION) -> str:
    """``bag, row_id`` of every bag drawn from ``source(row_id)``."""
    return f"""
SELECT CAST(bag AS INTEGER) AS bag, row_id FROM (
  SELECT bag, row_id, row_number() OVER (PARTITION BY bag ORDER BY {_bag_draw()}, CAST(row_id AS VARCHAR)) AS place,
         count(*) OVER (PARTITION BY bag) AS n
  FROM {source}, range({bags}) AS b(bag))
WHERE place <= floor(CAST({fraction} AS DOUBLE) * n)"""


# Bags with replacement: Poisson numbers of draws per row, of which the smallest marks are kept.
def _repeats(source: str, bags: int, fraction: float = FRACTION) -> str:
    """CTEs that end in ``repeats(bag, row_id, copies)``; they stand behind WITH RECURSIVE."""
    return f"""
keys AS (SELECT row_id FROM {source}),
wanted AS (SELECT count(*) AS n, floor(CAST({fraction} AS DOUBLE) * count(*)) AS k FROM keys),
rates AS (SELECT (k + 8.0::DOUBLE * (sqrt(k) + 1)) / n AS rate FROM wanted),
poisson AS (SELECT 0 AS j, exp(-rate) AS p, exp(-rate) AS c FROM rates
            UNION ALL SELECT j + 1, p * rate / (j + 1), c + p * rate / (j + 1) FROM poisson, rates
            WHERE j + 1 <= rate OR p * rate / (j + 1) * 2.0::DOUBLE ** 52 >= 0.5),
marks AS (SELECT printf('%013x', CAST(floor(c * 2.0::DOUBLE ** 52) AS BIGINT)) AS mark FROM poisson WHERE c < 1),
counted AS (SELECT bag, row_id, (SELECT count(*) FROM marks WHERE mark <= draw) AS n FROM (
              SELECT CAST(bag AS INTEGER) AS bag, row_id, substr(md5(concat_ws(':', 'count', '{SEED}', bag // 2, row_id)),
                     CAST(13 * (bag % 2) + 1 AS INTEGER), 13) AS draw FROM keys, range({bags}) AS b(bag))),
copies AS (SELECT bag, row_id, unnest(range(1, n + 1)) AS copy FROM counted),
ordered AS (SELECT bag, row_id, row_number() OVER (PARTITION BY bag ORDER BY
              substr(md5(concat_ws(':', 'copy', '{SEED}', bag, copy, row_id)), 1, 8), CAST(row_id AS VARCHAR), copy) AS place
            FROM copies),
repeats AS (SELECT bag, row_id, CAST(count(*) AS INTEGER) AS copies FROM ordered, wanted WHERE place <= k GROUP BY bag, row_id)"""


ORDER_IDS = "(SELECT o_orderkey AS row_id FROM orders)"


def _embeddings(is_train: str) -> str:
    return f"""
base AS (SELECT min(vec_id) AS row_id, arg_min(label, vec_id) AS label, embedding FROM embeddings GROUP BY embedding),
divided AS (SELECT row_id, CAST(label AS DOUBLE) AS label, embedding, {is_train} AS is_train FROM base)"""


EMBEDDINGS = _embeddings(_is_train())


# Naive Bayes on what ``source`` makes, divided(row_id, label, embedding, is_train): leaves long(row_id, label, member, prediction).
def _nb_members(
    bags: int, fraction: float = FRACTION, scope: str = "is_train", repeated: bool = False, source: str = EMBEDDINGS
) -> str:
    drawn = f"{_repeats('train', bags, fraction)},\nbags AS (SELECT bag, row_id, copies AS w FROM repeats)"
    if not repeated:
        drawn = f"bags AS (SELECT bag, row_id, 1 AS w FROM ({_bags('train', bags, fraction)}))"
    return f"""{source},
cells AS (SELECT row_id, label, is_train, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM divided),
ranges AS (SELECT j, min(x) AS lo, max(x) AS hi FROM cells WHERE {scope} GROUP BY j),
scaled AS (SELECT row_id, label, is_train, j,
                  CASE WHEN hi = lo THEN 0.5 ELSE least(greatest((x - lo) / (hi - lo), 0), 1) END AS x
           FROM cells JOIN ranges USING (j)),
train AS (SELECT row_id, label FROM divided WHERE is_train),
{drawn},
classes AS (SELECT bag, label AS class, sum(w) AS n FROM bags JOIN train USING (row_id) GROUP BY bag, label),
totals AS (SELECT bag, sum(n) AS n FROM classes GROUP BY bag),
sizes AS (SELECT max(label) + 1 AS k FROM train),
prior AS (SELECT bag, class, ln(classes.n + 1.0::DOUBLE)
                 - ln(totals.n + (SELECT count(*) FROM classes c WHERE c.bag = classes.bag)) AS pi
          FROM classes JOIN totals USING (bag)),
sums AS (SELECT bag, label AS class, j, sum(x * w) AS s FROM scaled JOIN bags USING (row_id) GROUP BY bag, label, j),
theta AS (SELECT bag, class, j, ln(s + 1) - ln(sum(s) OVER (PARTITION BY bag, class) + count(*) OVER (PARTITION BY bag, class)) AS t FROM sums),
scores AS (SELECT s.row_id, s.label, theta.bag, theta.class, sum(s.x * t) + any_value(pi) AS score
           FROM scaled s JOIN theta USING (j) JOIN prior ON prior.bag = theta.bag AND prior.class = theta.class
           WHERE NOT s.is_train GROUP BY s.row_id, s.label, theta.bag, theta.class),
long AS (SELECT row_id, label, CAST(bag AS INTEGER) AS member, class AS prediction FROM (
           SELECT *, row_number() OVER (PARTITION BY row_id, bag ORDER BY score DESC, class) AS place FROM scores)
         WHERE place = 1)"""


# Customers of several folds, the nation as only feature that is used, scaled: makes scaled(fold, row_id, label, is_train, x).
def _nations(seeds: dict[int, int]) -> str:
    return _nations_of({fold: _is_train(seed, "c_custkey") for fold, seed in seeds.items()})


def _nations_of(train_sides: dict[int, str]) -> str:
    divided = " UNION ALL ".join(
        f"SELECT {fold} AS fold, c_custkey AS row_id, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS label,"
        f" {is_train} AS is_train FROM customer"
        for fold, is_train in train_sides.items()
    )
    return f"""
divided AS ({divided}),
ranges AS (SELECT fold, min(nation) AS lo, max(nation) AS hi FROM divided WHERE is_train GROUP BY fold),
scaled AS (SELECT fold, row_id, label, is_train,
                  CASE WHEN hi = lo THEN 0.5 ELSE least(greatest((nation - lo) / (hi - lo), 0), 1) END AS x
           FROM divided JOIN ranges USING (fold))"""


# The same from the market segment, numbered by its frequency among all train rows, copies included.
def _segments(seeds: dict[int, int]) -> str:
    sides = " UNION ALL ".join(
        f"SELECT {fold} AS fold, c_custkey, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal,"
        f" {_is_train(seed, 'c_custkey')} AS is_train FROM customer"
        for fold, seed in seeds.items()
    )
    return f"""
sides AS ({sides}),
once AS (SELECT fold, is_train, segment, min(c_custkey) AS row_id, arg_min(c_acctbal, c_custkey) AS label
         FROM sides GROUP BY fold, is_train, segment, nation),
codes AS (SELECT fold, segment, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, segment) - 1 AS code,
                 count(*) OVER (PARTITION BY fold) AS n
          FROM sides WHERE is_train GROUP BY fold, segment),
scaled AS (SELECT fold, row_id, label, is_train, CAST(coalesce(code, n) AS DOUBLE) / (n - 1) AS x
           FROM once JOIN codes USING (fold, segment))"""


# Isotonic regression on what one of these makes: leaves long(fold, row_id, label, member, prediction).
def _isotonic(scaled: str, bags: int, fraction: float = FRACTION) -> str:
    return f"""{scaled},
bags AS (SELECT fold, CAST(bag AS INTEGER) AS bag, row_id, x, label FROM (
           SELECT *, row_number() OVER (PARTITION BY fold, bag ORDER BY {_bag_draw()}, CAST(row_id AS VARCHAR)) AS place,
                  count(*) OVER (PARTITION BY fold, bag) AS n
           FROM scaled, range({bags}) AS b(bag) WHERE is_train)
         WHERE place <= floor(CAST({fraction} AS DOUBLE) * n)),
points AS (SELECT fold, bag, x, count(*) AS w, sum(label) AS s FROM bags GROUP BY fold, bag, x),
sums AS (SELECT fold, bag, x, w, s, row_number() OVER o AS k, sum(w) OVER o AS cw, sum(s) OVER o AS cs
         FROM points WINDOW o AS (PARTITION BY fold, bag ORDER BY x)),
blocks AS (SELECT a.fold, a.bag, a.k AS i, b.k AS j, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean
           FROM sums a JOIN sums b ON a.fold = b.fold AND a.bag = b.bag AND a.k <= b.k),
lows AS (SELECT fold, bag, i, j AS k, min(mean) OVER (PARTITION BY fold, bag, i ORDER BY j DESC) AS low FROM blocks),
fitted AS (SELECT sums.fold, sums.bag, sums.x, max(low) AS y
           FROM lows JOIN sums ON sums.fold = lows.fold AND sums.bag = lows.bag AND sums.k = lows.k
           GROUP BY sums.fold, sums.bag, sums.x),
around AS (SELECT t.fold, t.row_id, t.label, t.x, f.bag, max(f.x) FILTER (WHERE f.x <= t.x) AS x0,
                  min(f.x) FILTER (WHERE f.x >= t.x) AS x1
           FROM scaled t JOIN fitted f ON f.fold = t.fold WHERE NOT t.is_train
           GROUP BY t.fold, t.row_id, t.label, t.x, f.bag),
long AS (SELECT a.fold, a.row_id, a.label, a.bag AS member,
                CASE WHEN x0 IS NULL THEN h.y WHEN x1 IS NULL OR x0 = x1 THEN l.y
                     ELSE l.y + (h.y - l.y) * (a.x - x0) / (x1 - x0) END AS prediction
         FROM around a LEFT JOIN fitted l ON l.fold = a.fold AND l.bag = a.bag AND l.x = a.x0
         LEFT JOIN fitted h ON h.fold = a.fold AND h.bag = a.bag AND h.x = a.x1)"""


def _isotonic_members(seeds: dict[int, int], bags: int, fraction: float = FRACTION) -> str:
    return _isotonic(_nations(seeds), bags, fraction)


# Lines whose features leave a gap between the classes: makes answers(row_id, label) of the test rows.
def _gap_rows(label: str) -> str:
    coded = (
        f"JOIN {_code('status', 'train_raw')} c ON c.value = status" if label == "code" else ""
    )
    return f"""
base AS (SELECT min(line_id) AS row_id, l_linestatus AS status
         FROM (SELECT {LINE_KEY} AS line_id, * FROM lineitem) GROUP BY l_linestatus, l_linenumber, l_discount, l_tax),
divided AS (SELECT *, {_is_train()} AS is_train FROM base),
train_raw AS (SELECT status FROM divided WHERE is_train),
answers AS (SELECT row_id, CAST({label} AS DOUBLE) AS label FROM divided {coded} WHERE NOT is_train)"""


LEVEL = "CASE status WHEN 'F' THEN 20 ELSE 10 END"
GAP_FIT = f"WITH {_gap_rows('code')} SELECT row_id, label, label AS prediction FROM answers"
LEVEL_FIT = f"WITH {_gap_rows(LEVEL)} SELECT row_id, label, label AS prediction FROM answers"


def _member_rows(methods: tuple[str, ...], each: int) -> str:
    names = [(i, m) for i, m in enumerate(m for m in methods for _ in range(each))]
    values = ", ".join(f"({i}, '{m}')" for i, m in [*names, (-1, "bagging")])
    return f"(VALUES {values}) AS members(member, method)"


def _report(values: str, metrics: list[str]) -> str:
    """All members and the ensemble with the metrics of ``values``, one row of one column per metric."""
    return f"""
SELECT 0 AS fold, CASE WHEN member < 0 THEN 'ensemble' ELSE 'member' END AS scope, method, CAST(member AS INTEGER) AS member,
       unnest({metrics}) AS metric, unnest([{", ".join(metrics)}]) AS value
FROM {values}"""


# All members and their vote answer the label, so the metrics are those of the label against itself.
GAP_METRICS = f"""
WITH {_gap_rows("code")},
perfect AS (SELECT avg(CASE WHEN label = label THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
                   avg(CASE WHEN label = label THEN 1.0::DOUBLE ELSE 0 END) AS "weightedPrecision" FROM answers)
{_report(f"perfect, {_member_rows(MIXED_METHODS, 2)}", ["accuracy", "weightedPrecision"]).replace(", weightedPrecision]", ', "weightedPrecision"]')}
"""
LEVEL_METRICS = f"""
WITH {_gap_rows(LEVEL)},
perfect AS (SELECT sqrt(avg((label - label) ** 2)) AS rmse, avg((label - label) ** 2) AS mse,
                   1 - avg((label - label) ** 2) / var_pop(label) AS r2, avg(abs(label - label)) AS mae FROM answers)
{_report(f"perfect, {_member_rows(LEVEL_METHODS, 2)}", ["rmse", "mse", "r2", "mae"])}
"""
PHASES = ("prepare", "bags", "fit", "score", "combine", "metrics", "total")


# Decision trees of depth 5 on three features of few values: leaves long(row_id, label, member,
# prediction). Thresholds lie halfway between neighbouring values of a bag; the best gain wins, the
# first feature and the lowest threshold among equals; a split needs a positive gain.
TREE_DEPTH = 5
GINI = "CASE WHEN {n} = 0 THEN 0 ELSE 1.0::DOUBLE - ({n0} / {n}) * ({n0} / {n}) - ({n1} / {n}) * ({n1} / {n}) END"
VARIANCE = "CASE WHEN {n} = 0 THEN 0 ELSE ({sq} - ({su} * {su}) / {n}) / {n} END"


# Lines of three features of few values: makes coded(row_id, label, is_train, l_discount, l_tax, l_linenumber).
def _lines(task: str) -> str:
    classes = task == "classification"
    label = "l_linestatus" if classes else "l_quantity"
    coded = (
        f"SELECT t.row_id, c.code AS label, t.is_train, l_discount, l_tax, l_linenumber FROM sided t "
        f"LEFT JOIN (SELECT value, code FROM {_code('label', 'train_raw')}) c ON c.value = t.label"
        if classes
        else "SELECT row_id, label, is_train, l_discount, l_tax, l_linenumber FROM sided"
    )
    return f"""
lines AS (SELECT min(line_id) AS row_id, arg_min({label}, line_id) AS label, l_discount, l_tax, l_linenumber
          FROM (SELECT {LINE_KEY} AS line_id, * FROM lineitem) GROUP BY l_discount, l_tax, l_linenumber),
sided AS (SELECT *, {_is_train()} AS is_train FROM lines),
train_raw AS (SELECT label FROM sided WHERE is_train),
coded AS ({coded})"""


# The same with scaled features and bags: makes cells(row_id, j, x), train, bags(bag, row_id) and splits(bag, j, t).
def _line_cells(task: str, bags: int, fraction: float) -> str:
    return f"""{_lines(task)},
wide AS (SELECT row_id, label, is_train, unnest(range(3)) AS j,
                unnest([l_discount, l_tax, CAST(l_linenumber AS DOUBLE)]) AS x FROM coded),
ranges AS (SELECT j, min(x) AS lo, max(x) AS hi FROM wide WHERE is_train GROUP BY j),
cells AS (SELECT row_id, j, least(greatest((x - lo) / (hi - lo), 0), 1) AS x FROM wide JOIN ranges USING (j)),
train AS (SELECT row_id FROM coded WHERE is_train),
bags AS ({_bags("train", bags, fraction)}),
points AS (SELECT DISTINCT bag, j, x FROM bags JOIN cells USING (row_id)),
splits AS (SELECT bag, j, t FROM (
             SELECT bag, j, (x + lead(x) OVER (PARTITION BY bag, j ORDER BY x)) / 2 AS t FROM points) WHERE t IS NOT NULL)"""


# One tree per bag, level by level, from {tree}nodes0(bag, row_id, label, in_bag, node) to {tree}nodes{depth}.
def _levels(classes: bool, depth: int, tree: str = "") -> str:
    parts = {"n": "1", "n0": "CAST(label = 0 AS INTEGER)", "n1": "CAST(label = 1 AS INTEGER)"}
    if not classes:
        parts = {"n": "1", "su": "label", "sq": "label * label"}

    def impurity(side):
        return (GINI if classes else VARIANCE).format(**{p: f"{side}{p}" for p in parts})

    left = ", ".join(f"CAST(sum(CASE WHEN x <= t THEN {e} ELSE 0 END) AS DOUBLE) AS l{p}" for p, e in parts.items())
    both = ", ".join(f"CAST(sum({e}) AS DOUBLE) AS a{p}" for p, e in parts.items())
    right = ", ".join(f"a{p} - l{p} AS r{p}" for p in parts)
    return ",".join(
        f"""
{tree}counts{d} AS (SELECT n.bag, n.node, s.j, s.t, {left}, {both}
              FROM {tree}nodes{d} n JOIN cells c USING (row_id) JOIN splits s ON s.bag = n.bag AND s.j = c.j
              WHERE n.in_bag GROUP BY n.bag, n.node, s.j, s.t),
{tree}sides{d} AS (SELECT *, {right} FROM {tree}counts{d}),
{tree}gains{d} AS (SELECT bag, node, j, t, {impurity("a")} - (ln / an) * ({impurity("l")}) - (rn / an) * ({impurity("r")}) AS gain
             FROM {tree}sides{d} WHERE ln > 0 AND rn > 0),
{tree}best{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bag, node ORDER BY gain DESC, j, t) AS place
                           FROM {tree}gains{d}) WHERE place = 1 AND gain > 0),
{tree}nodes{d + 1} AS MATERIALIZED (
  SELECT n.bag, n.row_id, n.label, n.in_bag,
         CASE WHEN b.t IS NULL THEN n.node WHEN c.x <= b.t THEN 2 * n.node ELSE 2 * n.node + 1 END AS node
  FROM {tree}nodes{d} n LEFT JOIN {tree}best{d} b ON b.bag = n.bag AND b.node = n.node
  LEFT JOIN cells c ON c.row_id = n.row_id AND c.j = b.j)"""
        for d in range(depth)
    )


def _tree_members(task: str, bags: int, fraction: float = FRACTION) -> str:
    classes = task == "classification"
    answer = (
        "CASE WHEN count(*) FILTER (WHERE label = 1) > count(*) FILTER (WHERE label = 0) THEN 1.0::DOUBLE ELSE 0 END"
        if classes
        else "avg(label)"
    )
    return f"""{_line_cells(task, bags, fraction)},
nodes0 AS (SELECT bag, row_id, label, true AS in_bag, 1 AS node FROM bags JOIN coded USING (row_id)
           UNION ALL SELECT CAST(bag AS INTEGER), row_id, label, false, 1 FROM coded, range({bags}) AS b(bag)
           WHERE NOT is_train),{_levels(classes, TREE_DEPTH)},
leaves AS (SELECT bag, node, {answer} AS prediction FROM nodes{TREE_DEPTH} WHERE in_bag GROUP BY bag, node),
long AS (SELECT row_id, label, bag AS member, prediction FROM nodes{TREE_DEPTH} JOIN leaves USING (bag, node)
         WHERE NOT in_bag)"""


# Boosted trees on the same lines: the first tree answers the label with weight 1, each later one twice what is left of it,
# which is the negative gradient of the squared error, with weight 0.1. Leaves long as above.
def _boosted_members(rounds: int, depth: int, bags: int, fraction: float = FRACTION) -> str:
    steps = []
    for r in range(rounds):
        left_over, weight, last = ("2 * (y - answer)", "0.1", f"boost{r - 1}") if r else ("y", "1.0", "start")
        steps.append(f"""t{r}nodes0 AS (SELECT bag, row_id, {left_over} AS label, in_bag, 1 AS node FROM {last}),{_levels(False, depth, f"t{r}")},
t{r}leaves AS (SELECT bag, node, avg(label) AS leaf FROM t{r}nodes{depth} WHERE in_bag GROUP BY bag, node),
boost{r} AS MATERIALIZED (
  SELECT s.bag, s.row_id, s.in_bag, s.y, s.answer + {weight}::DOUBLE * leaf AS answer
  FROM {last} s JOIN t{r}nodes{depth} n USING (bag, row_id, in_bag) JOIN t{r}leaves l ON l.bag = n.bag AND l.node = n.node)""")
    steps = ",\n".join(steps)
    return f"""{_line_cells("regression", bags, fraction)},
start AS (SELECT bag, row_id, true AS in_bag, CAST(label AS DOUBLE) AS y, 0.0::DOUBLE AS answer FROM bags JOIN coded USING (row_id)
          UNION ALL SELECT CAST(bag AS INTEGER), row_id, false, CAST(label AS DOUBLE), 0.0::DOUBLE
          FROM coded, range({bags}) AS b(bag) WHERE NOT is_train),
{steps},
long AS (SELECT row_id, y AS label, bag AS member, answer AS prediction FROM boost{rounds - 1} WHERE NOT in_bag)"""


# Members of two kinds on the same lines; the first half of the bags belongs to the first kind. Leaves long as above.
def _mixed_members(first: str, second: str, bags: int) -> str:
    return f"""
long AS (SELECT row_id, label, member, prediction FROM (WITH {first} SELECT * FROM long) WHERE member < {bags // 2}
         UNION ALL
         SELECT row_id, label, member, prediction FROM (WITH {second} SELECT * FROM long) WHERE member >= {bags // 2})"""


LINE_VECTORS = f"""{_lines("classification")},
divided AS (SELECT row_id, label, [l_discount, l_tax, CAST(l_linenumber AS DOUBLE)] AS embedding, is_train FROM coded)"""
LINE_DISCOUNTS = f"""{_lines("regression")},
sided_range AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi FROM coded WHERE is_train),
scaled AS (SELECT 0 AS fold, row_id, label, is_train, least(greatest((l_discount - lo) / (hi - lo), 0), 1) AS x
           FROM coded, sided_range)"""
BAYES_AND_TREES = _mixed_members(
    _nb_members(MIXED_BAGS, source=LINE_VECTORS), _tree_members("classification", MIXED_BAGS), MIXED_BAGS
)
TREES_AND_ISOTONIC = _mixed_members(_tree_members("regression", MIXED_BAGS), _isotonic(LINE_DISCOUNTS, MIXED_BAGS), MIXED_BAGS)


def _fold_metrics(members: str) -> str:
    """CTEs that end in report(fold, scope, method, member, metric, value) of isotonic members."""
    return f"""
WITH {members},
answers AS (
  SELECT fold, member, label, prediction FROM long
  UNION ALL
  SELECT fold, NULL AS member, any_value(label) AS label, avg(prediction) AS prediction FROM long GROUP BY fold, row_id),
wide AS (
  SELECT fold, member, sqrt(avg((label - prediction) ** 2)) AS rmse, avg((label - prediction) ** 2) AS mse,
         1 - avg((label - prediction) ** 2) / var_pop(label) AS r2, avg(abs(label - prediction)) AS mae
  FROM answers GROUP BY fold, member),
report AS (
  SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN member IS NULL THEN 'ensemble' ELSE 'member' END AS scope,
         CASE WHEN member IS NULL THEN 'bagging' ELSE 'Isotonic' END AS method,
         CAST(coalesce(member, -1) AS INTEGER) AS member, metric, value
  FROM (SELECT fold, member, unnest(['rmse', 'mse', 'r2', 'mae']) AS metric, unnest([rmse, mse, r2, mae]) AS value
        FROM wide))
"""


FOLD_METRICS = _fold_metrics(_isotonic_members({i: s for i, s in enumerate(FOLD_SEEDS, start=1)}, 2))
PART_METRICS = _fold_metrics(_isotonic(_nations_of({i + 1: _outside_part(i, PARTS, "c_custkey") for i in range(PARTS)}), 2))
PART_VOTES = " UNION ALL ".join(
    f"SELECT {i + 1} AS fold, * FROM (WITH {_nb_members(3, source=_embeddings(_outside_part(i, PARTS)))} {VOTE})" for i in range(PARTS)
)


def _class_report(members: str, method: str) -> str:
    return f"""
WITH {members},
voted AS ({VOTE}),
answers AS (SELECT member, label, prediction FROM long
            UNION ALL SELECT -1 AS member, label, "baggingPrediction" AS prediction FROM voted),
values_ AS (
  SELECT member, 'accuracy' AS metric, value FROM ({ACCURACY.replace("FROM long", "FROM answers")})
  UNION ALL
  SELECT member, 'weightedPrecision' AS metric, value FROM ({PRECISION.replace("FROM long", "FROM answers")}))
SELECT 0 AS fold, CASE WHEN member < 0 THEN 'ensemble' ELSE 'member' END AS scope,
       CASE WHEN member < 0 THEN 'bagging' ELSE {method} END AS method, CAST(member AS INTEGER) AS member,
       metric, round(value, 6) AS value
FROM values_
"""


# Six digits for r2, three for errors: sums in the millions are not exact beyond that.
ROUNDED = "CASE WHEN metric = 'r2' THEN round({v}, 6) ELSE round({v}, 3) END"

CUST_SIGN = "CAST(sign(c_acctbal) AS INTEGER)"
SCALED = "round((CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 9)"

ORACLES: dict[str, str] = {
    "csv_scan": """
SELECT CAST(p_partkey AS INTEGER) AS _c0, p_name AS _c1, p_brand AS _c2, p_type AS _c3, p_size AS _c4,
       p_retailprice AS _c5 FROM part""",
    "input_repartition": """
SELECT CAST(16 AS BIGINT) AS n_partitions, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders""",
    "schema_inspection": """
SELECT 0 AS position, 'c_custkey' AS column_name, 'key' AS column_role, false AS is_nominal, count(c_custkey) AS n_values FROM customer
UNION ALL SELECT 1, 'c_name', 'feature', true, count(c_name) FROM customer
UNION ALL SELECT 2, 'c_nationkey', 'feature', false, count(c_nationkey) FROM customer
UNION ALL SELECT 3, 'c_acctbal', 'feature', false, count(c_acctbal) FROM customer
UNION ALL SELECT 4, 'c_mktsegment', 'label', true, count(c_mktsegment) FROM customer""",
    "nominal_index": f"""
SELECT p_partkey, n.code AS p_name, b.code AS p_brand, t.code AS p_type FROM part
JOIN {_code("p_name", "part")} n ON n.value = p_name
JOIN {_code("p_brand", "part")} b ON b.value = p_brand
JOIN {_code("p_type", "part")} t ON t.value = p_type""",
    "label_index": f"""
SELECT {LINE_KEY} AS row_id, f.code AS label FROM lineitem
JOIN {_code("l_returnflag", "lineitem")} f ON f.value = l_returnflag""",
    "numeric_label": """
SELECT p_partkey AS row_id, p_retailprice, CAST(p_size AS DOUBLE) AS label FROM part""",
    "negative_label_test": f"SELECT min({CUST_SIGN}) < 0 AS has_negative FROM customer",
    "negative_label_reindex": f"""
WITH signs AS (SELECT c_custkey, printf('%d.0', {CUST_SIGN}) AS sign FROM customer)
SELECT c_custkey AS row_id, code AS label FROM signs JOIN {_code("sign", "signs")} c ON c.value = sign""",
    "cast_features": """
SELECT event_id AS row_id, round(epoch_us(ts) / 1e6, 6) AS ts,
       CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS day,
       CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS even_user,
       CAST(user_id AS DOUBLE) AS user_id, value AS label FROM events""",
    "assemble_features": f"""
SELECT {LINE_KEY} AS row_id, CAST(unnest(range(4)) AS INTEGER) AS position,
       round(unnest([l_quantity, l_extendedprice, l_discount, l_tax]), 9) AS value FROM lineitem""",
    "minmax_scale": f"""
SELECT {LINE_KEY} AS row_id,
       {", ".join(f"{SCALED.format(c=c)} AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))}
FROM lineitem""",
    "dedupe_features": f"""
SELECT min(c_custkey) AS row_id, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_mktsegment,
       CAST(arg_min({CUST_SIGN}, c_custkey) AS DOUBLE) AS label, count(*) AS copies
FROM customer GROUP BY c_nationkey, c_mktsegment""",
    "dedupe_without_key": """
SELECT md5(concat_ws('|', concat_ws('=', length(p_brand), p_brand), concat_ws('=', length(p_type), p_type))) AS row_id,
       p_brand, p_type, min(p_retailprice) AS label, count(*) AS copies
FROM part GROUP BY p_brand, p_type""",
    "prepared_dataset": f"""
WITH coded AS (
  SELECT p_partkey, p_retailprice, CAST(p_partkey AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS x1, b.code AS x2, t.code AS x3
  FROM part JOIN {_code("p_brand", "part")} b ON b.value = p_brand JOIN {_code("p_type", "part")} t ON t.value = p_type)
SELECT p_partkey AS row_id, p_retailprice AS label, CAST(unnest(range(4)) AS INTEGER) AS position,
       unnest([{", ".join(SCALED.format(c=f"x{i}") for i in range(4))}]) AS value FROM coded""",
    "doc_quality_features": r"""
WITH words AS (
  SELECT *, [w FOR w IN regexp_split_to_array(text, '[ \n\t\r]+') IF w <> ''] AS w FROM documents JOIN labels USING (doc_id))
SELECT doc_id, n_chars,
       round(1 - length(regexp_replace(text, '\P{L}', '', 'g')) / greatest(length(text), 1), 9) AS nonletter_ratio,
       round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 9) AS digit_ratio,
       round(len(list_distinct(w)) / greatest(len(w), 1), 9) AS distinct_word_ratio,
       CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, lang, source, quality
FROM words""",
    "hash_split_orders": f"""
SELECT row_id, CASE WHEN {_is_train()} THEN 'train' ELSE 'test' END AS part FROM {ORDER_IDS}""",
    "bag_with_replacement": f"WITH RECURSIVE {_repeats(ORDER_IDS, 3)} SELECT bag, row_id, copies FROM repeats",
    "bag_exact": _bags(ORDER_IDS, 3),
    "bag_bucketed": _bags(f"(SELECT {LINE_KEY} AS row_id FROM lineitem)", 3),
    "bag_approximate": f"""
SELECT CAST(bag AS INTEGER) AS bag, row_id FROM {ORDER_IDS}, range(3) AS b(bag)
WHERE {_bag_draw()} < '{_mark(FRACTION)}'""",
    "bag_label_order": f"""
WITH bags AS ({_bags("(SELECT c_custkey AS row_id FROM customer)", 2)})
SELECT row_id, CAST(c_nationkey AS DOUBLE) AS label, row_number() OVER (ORDER BY c_nationkey, row_id) - 1 AS position
FROM bags JOIN customer ON c_custkey = row_id WHERE bag = 1""",
    "member_allocation": f"""
SELECT bag AS member, CASE least(bag // (10 // 3), 2) WHEN 0 THEN 'NaiveBayes' WHEN 1 THEN 'DecisionTree' ELSE 'RandomForest' END AS method,
       count(*) AS n_rows FROM ({_bags(ORDER_IDS, 10)}) GROUP BY bag""",
    "dataset_profile": """
SELECT count(*) AS n_rows, max(len(embedding))::INTEGER AS n_features, max(label) + 1 AS n_classes FROM embeddings""",
    "vote_wide": f"WITH long AS ({FLAG_LONG}) {VOTE}",
    "vote_by_group": f"WITH long AS ({FLAG_LONG}) {VOTE}",
    "mean_combine": f"WITH long AS ({PRICE_LONG}) {MEAN}",
    "mean_by_group": f"WITH long AS ({PRICE_LONG}) {MEAN}",
    "members_join": FLAG_LONG,
    "row_vectorise": f"""
SELECT row_id, label, member, round(prediction, 6) AS prediction FROM ({PRICE_LONG})""",
    "accuracy": f"""
WITH long AS ({FLAG_LONG}) SELECT member, round(value, 6) AS accuracy FROM ({ACCURACY})""",
    "weighted_precision": f"""
WITH long AS ({FLAG_LONG}) SELECT member, round(value, 6) AS "weightedPrecision" FROM ({PRECISION})""",
    "regression_metrics": f"""
WITH long AS ({PRICE_LONG})
SELECT member, round(rmse, 6) AS rmse, round(mse, 6) AS mse, round(r2, 6) AS r2, round(mae, 6) AS mae FROM ({ERRORS})""",
    "classifier_report": f"""
WITH long AS ({FLAG_LONG})
SELECT member, 'accuracy' AS metric, round(value, 6) AS value FROM ({ACCURACY})
UNION ALL SELECT member, 'weightedPrecision' AS metric, round(value, 6) AS value FROM ({PRECISION})""",
    "regressor_report": f"""
WITH long AS ({PRICE_LONG})
SELECT member, unnest(['rmse', 'mse', 'r2', 'mae']) AS metric, round(unnest([rmse, mse, r2, mae]), 6) AS value
FROM ({ERRORS})""",
    "vector_index_categories": f"""
WITH wide AS (SELECT {LINE_KEY} AS row_id, CAST(l_linenumber AS DOUBLE) AS a, l_quantity AS b, l_discount AS c, l_tax AS d
              FROM lineitem),
cells AS (SELECT row_id, CAST(unnest(range(4)) AS INTEGER) AS position, unnest([a, b, c, d]) AS x FROM wide),
kinds AS (SELECT position, x, count(*) OVER (PARTITION BY position) AS n,
                 row_number() OVER (PARTITION BY position ORDER BY x) - 1 AS code
          FROM (SELECT DISTINCT position, x FROM cells))
SELECT row_id, position, round(CASE WHEN n <= 10 THEN CAST(code AS DOUBLE) ELSE x END, 9) AS value
FROM cells JOIN kinds USING (position, x)""",
    "label_roundtrip": f"""
WITH labels_ AS (SELECT {LINE_KEY} AS row_id, CAST({FLAG} AS DOUBLE) AS label FROM lineitem)
SELECT row_id, label, code AS indexed_label, label AS restored
FROM labels_ JOIN {_code("label", "labels_")} c ON c.value = label""",
    "fit_nb": f"WITH {_nb_members(1, 1.0)} SELECT row_id, label, round(prediction, 6) AS prediction FROM long",
    "fit_isotonic": f"""
WITH {_isotonic_members({0: SEED}, 1, 1.0)} SELECT row_id, label, round(prediction, 6) AS prediction FROM long""",
    **{f"fit_{name}": GAP_FIT for name in ("svm", "mlp", "logreg", "dt_cls", "rf_cls")},
    **{f"fit_{name}": LEVEL_FIT for name in ("dt_reg", "rf_reg", "gbt_reg")},
    "bagging_classification": GAP_METRICS,
    "bagging_mixed_vote": f"""WITH {_gap_rows("code")} SELECT row_id, label, label AS "baggingPrediction" FROM answers""",
    "bagging_regression": LEVEL_METRICS,
    "phase_timings": f"SELECT 0 AS fold, unnest({list(PHASES)}) AS phase, true AS is_positive",
    "folds_fit_on_all": f"""
WITH {_isotonic(_segments({i: s for i, s in enumerate(FOLD_SEEDS, start=1)}), 2)}
SELECT fold, row_id, label, round(avg(prediction), 6) AS "baggingPrediction" FROM long GROUP BY fold, row_id, label""",
    "fit_dt_cls_few_values": f"""
WITH {_tree_members("classification", 1, 1.0)} SELECT row_id, label, round(prediction, 6) AS prediction FROM long""",
    "fit_dt_reg_few_values": f"""
WITH {_tree_members("regression", 1, 1.0)} SELECT row_id, label, round(prediction, 6) AS prediction FROM long""",
    "bagged_dt_vote": f"WITH {_tree_members('classification', 5)} {VOTE}",
    "bagged_dt_mean": f"WITH {_tree_members('regression', 5)} {MEAN}",
    "fit_gbt_reg_few_values": f"""
WITH {_boosted_members(BOOST_ROUNDS, BOOST_DEPTH, 1, 1.0)} SELECT row_id, label, round(prediction, 6) AS prediction FROM long""",
    "mixed_nb_dt_members": f"WITH {BAYES_AND_TREES} SELECT row_id, label, member, prediction FROM long",
    "mixed_nb_dt_vote": f"WITH {BAYES_AND_TREES} {VOTE}",
    "mixed_nb_dt_metrics": _class_report(
        BAYES_AND_TREES, f"CASE WHEN member < {MIXED_BAGS // 2} THEN 'NaiveBayes' ELSE 'DecisionTree' END"
    ),
    "mixed_dt_isotonic_mean": f"WITH {TREES_AND_ISOTONIC} {MEAN}",
    "bagged_nb_vote": f"WITH {_nb_members(3)} {VOTE}",
    "bagged_nb_members": f"WITH {_nb_members(3)} SELECT row_id, label, member, prediction FROM long",
    "bagged_nb_with_replacement": f"WITH RECURSIVE {_nb_members(3, repeated=True)} SELECT row_id, label, member, prediction FROM long",
    "bagged_nb_metrics": _class_report(_nb_members(3), "'NaiveBayes'"),
    "bagged_tree_vote": _class_report(_tree_members("classification", 5), "'DecisionTree'"),
    "bagged_nb_fit_on_all": f"WITH {_nb_members(3, scope='true')} {VOTE}",
    "bagged_isotonic_mean": f"WITH {_isotonic_members({0: SEED}, 3)} {MEAN}",
    "bagging_prepared_tables": f"WITH {_nb_members(3)} {VOTE}",
    "fold_runs": f"""
{FOLD_METRICS} SELECT fold, scope, method, member, metric, {ROUNDED.format(v="value")} AS value FROM report""",
    "fold_summary": f"""
{FOLD_METRICS} SELECT metric, count(*) AS folds, {ROUNDED.format(v="avg(value)")} AS mean,
       {ROUNDED.format(v="stddev_samp(value)")} AS stddev
FROM report WHERE scope = 'ensemble' GROUP BY metric""",
    "kfold_metrics": f"""
{PART_METRICS} SELECT fold, scope, method, member, metric, {ROUNDED.format(v="value")} AS value FROM report""",
    "kfold_nb_vote": PART_VOTES,
    "prediction_sink": FLAG_LONG,
}

"""The SQL each registered query is checked against (DuckDB over the same tables).

Written from the definitions, not from the Spark plans: plain windows instead of
buckets, closed forms instead of solves, joins instead of literals.
"""

from __future__ import annotations

# -- shared table expressions -------------------------------------------------------

PAIRS = """pairs AS (
  SELECT b.conv_id * 1000000000 + b.turn AS row_id, a.text AS context, b.text AS target,
         CAST((b.conv_id * 7 + b.turn) % 3 AS VARCHAR) AS label,
         CASE WHEN b.conv_id % 2 = 0 THEN 'gold' ELSE 'silver' END AS tier
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""

ANNOTATED = PAIRS + """, annotated AS (
  SELECT row_id, context, target,
         CASE row_id % 4 WHEN 0 THEN 'h' WHEN 1 THEN 'n' WHEN 2 THEN 'c' ELSE 'other' END AS annotation FROM pairs)"""

DOCLABELS = """doclabels AS (
  SELECT l.doc_id AS row_id, d.n_chars, l.toxic AS y_true,
         CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

LOGITS = """logits AS (
  SELECT vec_id AS row_id, CAST(label % 3 AS INTEGER) AS y_true,
         10 * CAST(embedding[1] AS DOUBLE) AS x0, 10 * CAST(embedding[2] AS DOUBLE) AS x1,
         10 * CAST(embedding[3] AS DOUBLE) AS x2 FROM embeddings),
shifted AS (SELECT *, greatest(x0, x1, x2) AS top FROM logits),
exps AS (SELECT *, exp(x0 - top) AS e0, exp(x1 - top) AS e1, exp(x2 - top) AS e2 FROM shifted),
scored AS (
  SELECT row_id, y_true, x0, x1, x2, top, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1,
         e2 / (e0 + e1 + e2) AS p2, ln(e0 + e1 + e2) + top AS lse,
         CASE WHEN x0 = top THEN 0 WHEN x1 = top THEN 1 ELSE 2 END AS y_pred FROM exps)"""

FLAGS = """flags AS (
  SELECT doc_id AS row_id, toxic AS y_true, 1 - quality AS y_pred,
         (505 + (doc_id * 37) % 490) / 1000.0::DOUBLE AS p FROM labels),
scored AS (
  SELECT row_id, y_true, y_pred, CASE WHEN y_pred = 0 THEN p ELSE 1 - p END AS p0,
         CASE WHEN y_pred = 0 THEN 1 - p ELSE p END AS p1 FROM flags)"""

STEPS = """steps AS (
  SELECT event_id AS row_id, ts, user_id AS run, CAST(day(ts) AS INTEGER) AS epoch,
         CASE WHEN event_id % 5 = 0 THEN 'valid' ELSE 'train' END AS phase, value AS loss,
         (event_id % 10) / 10.0::DOUBLE AS accuracy, (event_id % 7) * 0.5::DOUBLE + 0.25::DOUBLE AS seconds
  FROM events)"""

# counts of each class against the rest, from (y_true, y_pred)
RATES = """classes AS (SELECT DISTINCT y_true AS cls FROM scored UNION SELECT DISTINCT y_pred FROM scored),
counts AS (
  SELECT cls, count(*) FILTER (y_true = cls AND y_pred = cls) AS tp,
         count(*) FILTER (y_true <> cls AND y_pred = cls) AS fp,
         count(*) FILTER (y_true <> cls AND y_pred <> cls) AS tn,
         count(*) FILTER (y_true = cls AND y_pred <> cls) AS fn
  FROM classes, scored GROUP BY cls),
ratios AS (
  SELECT cls, tp, fp, tn, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall FROM counts),
rates AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
         (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM ratios)"""

KAPPA = """(SELECT CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END FROM
  (SELECT sum(tp) / sum(tp + fn)::DOUBLE AS po,
          sum((tp + fn)::DOUBLE * (tp + fp)) / (sum(tp + fn)::DOUBLE * sum(tp + fn)) AS pe FROM rates))"""


def _elapsed(seconds: str) -> str:
    s = f"CAST(round_even({seconds}, 0) AS BIGINT)"
    return (
        f"CASE WHEN {s} >= 86400 THEN ({s} // 86400)::VARCHAR || CASE WHEN {s} // 86400 = 1 THEN ' day, ' "
        f"ELSE ' days, ' END ELSE '' END || ({s} % 86400 // 3600)::VARCHAR || ':' || "
        f"lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0')"
    )


def _hash(seed: object, key: str) -> str:
    return f"md5('{seed}:' || {key})"


def _number(digest: str, digits: int = 15) -> str:
    return f"CAST('0x' || substr({digest}, 1, {digits}) AS BIGINT)"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: t <> '')"


def _vocab(texts: str, size: int | None = None) -> str:
    limit = f" LIMIT {size}" if size else ""
    return f"""words AS (SELECT unnest({_tokens('text')}) AS token FROM ({texts})),
vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id FROM
    (SELECT token, count(*) AS n FROM words GROUP BY token ORDER BY n DESC, token{limit}))"""


TEXTS = PAIRS + ", texts AS (SELECT row_id, context || ' [SEP] ' || target AS text FROM pairs)"
PAIR_VOCAB = _vocab("SELECT context AS text FROM pairs UNION ALL SELECT target FROM pairs")


def _ids(source: str, text: str, limit: int, out: str) -> str:
    """CTE ``out``: row_id and the ids of the first ``limit`` tokens ([] for none)."""
    return f"""{out}_tok AS (
  SELECT row_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT row_id, {_tokens(text)}[1:{limit}] AS t FROM {source})),
{out} AS (
  SELECT s.row_id, coalesce(ids, []) AS ids FROM {source} s LEFT JOIN
    (SELECT row_id, list(coalesce(id, 3) ORDER BY pos) AS ids FROM {out}_tok LEFT JOIN vocab USING (token)
     GROUP BY row_id) g ON s.row_id = g.row_id)"""


def _padded(ids: str, length: str) -> str:
    return f"""array_to_string(list_concat({ids}, list_transform(range({length} - len({ids})), lambda i: 1)), ',') AS ids,
  array_to_string(list_concat(list_transform({ids}, lambda i: 1),
    list_transform(range({length} - len({ids})), lambda i: 0)), ',') AS mask"""


def _encode_text(source: str, text: str, length: int = 512, pad: str | None = None) -> str:
    size = "(SELECT max(len(full_ids)) FROM framed)" if pad == "longest" else str(length)
    return f"""{_ids(source, text, length - 2, 'enc')},
framed AS (SELECT row_id, list_concat([0], ids, [2]) AS full_ids FROM enc)
SELECT row_id, {_padded('full_ids', size)} FROM framed"""


def _pair_frame(source: str, length: int) -> str:
    budget = length - 4
    return f"""{_ids(source, 'target', budget, 'ea')}, {_ids(source, 'context', budget, 'eb')},
sized AS (SELECT a.row_id, a.ids AS a, b.ids AS b, len(a.ids) AS la, len(b.ids) AS lb
  FROM ea a JOIN eb b ON a.row_id = b.row_id),
cut AS (SELECT *, CASE WHEN la + lb <= {budget} THEN lb
  ELSE least(lb, greatest({budget} - la, {budget // 2})) END AS kb FROM sized),
framed AS (SELECT row_id, list_concat([0], a[1:CASE WHEN la + lb <= {budget} THEN la ELSE {budget} - kb END],
  [2, 2], b[1:kb], [2]) AS full_ids FROM cut)"""


def _upsample(source: str, key: str, draws: str, columns: str, seed: int = 123) -> str:
    """CTE ``ups`` over a table with ``label`` in {0, 1}; ``key`` is a VARCHAR expression."""
    return f"""minority AS (
  SELECT *, row_number() OVER (ORDER BY {_hash(seed, key)}, row_id) - 1 AS spot FROM {source} WHERE label = 1),
sizes AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM {source}),
draws AS (
  SELECT j, {_number(_hash(f'{seed}:draw', 'j'))} % (SELECT n1 FROM sizes) AS spot
  FROM (SELECT unnest(range(CAST({draws} AS BIGINT))) AS j FROM sizes)),
ups AS (
  SELECT {columns}, CAST(-1 AS BIGINT) AS draw_no FROM {source} WHERE label = 0
  UNION ALL SELECT {columns}, row_number() OVER (PARTITION BY spot ORDER BY j) - 1 AS draw_no
  FROM minority JOIN draws USING (spot))"""


IMBALANCED = "imbalanced AS (SELECT doc_id AS row_id, toxic AS label FROM labels)"
BINARY_PAIRS = PAIRS + """, twoclass AS (
  SELECT row_id, tier, context, target, CASE WHEN label IN ('0', '1') THEN 0 ELSE 1 END AS label FROM pairs)"""

# weights for three classes by cofactors of the joint distribution (rows predicted, columns true)
WEIGHTS = LOGITS + """,
val AS (SELECT * FROM scored WHERE row_id % 2 = 0), test AS (SELECT * FROM scored WHERE row_id % 2 = 1),
joint AS (SELECT """ + ", ".join(
    f"count(*) FILTER (y_pred = {i} AND y_true = {j}) / count(*)::DOUBLE AS c{i}{j}" for i in range(3) for j in range(3)
) + """ FROM val),
mu AS (SELECT """ + ", ".join(f"count(*) FILTER (y_pred = {i}) / count(*)::DOUBLE AS m{i}" for i in range(3)) + """ FROM test),
det AS (SELECT *, c00 * (c11 * c22 - c12 * c21) - c01 * (c10 * c22 - c12 * c20) + c02 * (c10 * c21 - c11 * c20) AS d
  FROM joint, mu),
solved AS (SELECT
  greatest((m0 * (c11 * c22 - c12 * c21) - c01 * (m1 * c22 - c12 * m2) + c02 * (m1 * c21 - c11 * m2)) / d, 0) AS w0,
  greatest((c00 * (m1 * c22 - c12 * m2) - m0 * (c10 * c22 - c12 * c20) + c02 * (c10 * m2 - m1 * c20)) / d, 0) AS w1,
  greatest((c00 * (c11 * m2 - m1 * c21) - c01 * (c10 * m2 - m1 * c20) + m0 * (c10 * c21 - c11 * c20)) / d, 0) AS w2
  FROM det)"""

ADJUSTED = WEIGHTS + """,
moved AS (SELECT row_id, y_pred, w0, w1, w2, w0 * p0 AS v0, w1 * p1 AS v1, w2 * p2 AS v2 FROM test, solved),
adjusted AS (SELECT row_id, y_pred, CASE WHEN v0 + v1 + v2 = 0 THEN w0 ELSE v0 / (v0 + v1 + v2) END AS a0,
  CASE WHEN v0 + v1 + v2 = 0 THEN w1 ELSE v1 / (v0 + v1 + v2) END AS a1,
  CASE WHEN v0 + v1 + v2 = 0 THEN w2 ELSE v2 / (v0 + v1 + v2) END AS a2 FROM moved)"""

# two classes: inverse of a 2 x 2 matrix of counts a b / c d (rows true, columns predicted)
WEIGHTS_OF_TWO = """
cells AS (SELECT count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS a, count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS b,
  count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS c, count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS d
  FROM scored WHERE row_id % 2 = 0),
mu AS (SELECT avg(CASE WHEN y_pred = 0 THEN 1.0 ELSE 0.0 END) AS m0, avg(CASE WHEN y_pred = 1 THEN 1.0 ELSE 0.0 END) AS m1
  FROM scored WHERE row_id % 2 = 1),
solved AS (SELECT CASE WHEN a * d = b * c THEN 0 ELSE (a + b + c + d) * (d * m0 - c * m1) / (a * d - b * c) END AS w0,
  CASE WHEN a * d = b * c THEN 0 ELSE (a + b + c + d) * (a * m1 - b * m0) / (a * d - b * c) END AS w1,
  a * d = b * c AS degenerate FROM cells, mu)"""
BINARY_WEIGHTS = f"{FLAGS}, {WEIGHTS_OF_TWO}"
CORRECTED = """,
clipped AS (SELECT greatest(w0, 0) AS w0, greatest(w1, 0) AS w1 FROM solved),
test AS (SELECT y_true, y_pred AS before, CASE WHEN w0 * p0 >= w1 * p1 THEN 0 ELSE 1 END AS after
  FROM scored, clipped WHERE row_id % 2 = 1),
both_stages AS (SELECT 'before' AS stage, y_true, before AS y_pred FROM test UNION ALL SELECT 'after', y_true, after FROM test),
cell AS (SELECT stage, count(*)::DOUBLE AS n, count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1)::DOUBLE AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0)::DOUBLE AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE AS tn FROM both_stages GROUP BY stage),
agree AS (SELECT *, (tp + tn) / n AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe FROM cell)"""
BEFORE_AND_AFTER = (
    "SELECT stage, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round((po - pe) / nullif(1 - pe, 0), 6) AS cohen_kappa, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS roc_auc FROM agree"
)


def _long(source: str, columns: list[str], value: str, keys: str = "row_id", pos: str = "pos") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, CAST({i} AS INTEGER) AS {pos}, round({c}, 6) AS {value} FROM {source}" for i, c in enumerate(columns)
    )


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def _stats() -> str:
    return f"""stats AS (SELECT epoch, avg(loss) FILTER (phase = 'train') AS train_loss,
  avg(loss) FILTER (phase = 'valid') AS valid_loss, avg(accuracy) FILTER (phase = 'valid') AS valid_accuracy,
  {_elapsed("coalesce(sum(seconds) FILTER (phase = 'train'), 0)")} AS train_time,
  {_elapsed("coalesce(sum(seconds) FILTER (phase = 'valid'), 0)")} AS valid_time FROM steps GROUP BY epoch)"""


BEST = STEPS + """, past AS (
  SELECT run, row_id, loss / 10 AS loss, min(loss / 10) OVER
    (PARTITION BY run ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM steps),
flagged AS (SELECT run, row_id, loss, loss < least(1, coalesce(prev, 1)) AS saved FROM past)"""

BATCHED = FLAGS + """,
batched AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 16) AS BIGINT) AS batch_id FROM scored)"""

SPLIT = f"CASE WHEN {_number(_hash(123, 'row_id'))} % 10 < 9 THEN 'train' ELSE 'val' END"

# content key of a pair: presence flag and text of each column, then the number of the copy
def _keyed(tier: str) -> str:
    return PAIRS + f""",
content AS (SELECT context, target, label,
  md5('1:' || length(context) || ':' || context || '1:' || length(target) || ':' || target || '1:1:' || label) AS digest FROM pairs WHERE tier = '{tier}'),
keyed AS (SELECT digest || '-' || (row_number() OVER (PARTITION BY digest) - 1) AS row_id, context, target,
  CASE WHEN label IN ('0', '1') THEN 0 ELSE 1 END AS label FROM content)"""


def _prepare(tier: str) -> str:
    key = "(row_id || ':' || draw_no)"
    return _with(
        f"""{_keyed(tier)}, {_upsample('keyed', 'row_id', 'n0', 'row_id, context, target, label')},
ranked AS (SELECT *, row_number() OVER (ORDER BY {_hash(123, key)}, row_id, draw_no) AS place FROM ups),
nulled AS (SELECT {key} AS row_id, row_id AS pair_id, draw_no, label, target,
  CASE WHEN place <= floor(0.25 * (SELECT count(*) FROM ups)) THEN '' ELSE context END AS context FROM ranked),
{_vocab("SELECT context AS text FROM keyed UNION ALL SELECT target FROM keyed")},
{_pair_frame('nulled', 512)}""",
        f"""SELECT '{tier}' AS tier, pair_id AS row_id, draw_no, label, ids, mask, CAST(768 AS INTEGER) AS width FROM nulled JOIN
  (SELECT row_id, {_padded('full_ids', '512')} FROM framed) f USING (row_id)""",
    )


def _prepare_splits() -> str:
    text = "'1:' || length({0}) || ':' || {0}".format
    return _with(
        f"""{PAIRS}, content AS (SELECT {SPLIT} AS split, context, target, label,
  md5({text('context')} || {text('target')} || '1:1:' || label) AS digest FROM pairs WHERE tier = 'gold'),
keyed AS (SELECT split || '/' || digest || '-' || (row_number() OVER (PARTITION BY split, digest) - 1) AS row_id, split, context, target,
  CASE WHEN label IN ('0', '1') THEN 0 ELSE 1 END AS label FROM content),
{_vocab("SELECT context AS text FROM keyed WHERE split = 'train' UNION ALL SELECT target FROM keyed WHERE split = 'train'")},
{_pair_frame('keyed', 512)}""",
        f"""SELECT split, split_part(row_id, '/', 2) AS row_id, label, ids, CAST(768 AS INTEGER) AS width FROM keyed JOIN
  (SELECT row_id, {_padded('full_ids', '512')} FROM framed) f USING (row_id)""",
    )


def _slopes(classes: list[int], coefficients: int) -> str:
    return (
        f"SELECT CAST(c AS INTEGER) AS cls, CAST(p AS INTEGER) AS pos, 0.0::DOUBLE AS slope FROM (SELECT unnest({classes}) AS c), "
        f"(SELECT unnest(range(-1, {coefficients})) AS p)"
    )


def _unseen(condition: str) -> str:
    return (
        "SELECT vec_id AS row_id, CAST(label >= 5 AS INTEGER) AS label, CAST(2 AS INTEGER) AS k, 1.0::DOUBLE AS total, true AS best "
        f"FROM embeddings WHERE {condition}"
    )


# Logistic regression of (label >= 5) on two components and an intercept, penalty |w|^2 / 2, by Newton steps;
# the three unknowns of a step by determinants.
PLANE = "plane AS (SELECT vec_id AS row_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, (label >= 5)::INTEGER AS y FROM embeddings)"
ODDS = "1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2)))"
DET = "h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02)"
MOVES = [
    "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det",
    "(h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det",
    "(h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - h02 * g1) + g0 * (h01 * h12 - h11 * h02)) / det",
]


def _derivatives(over: str, weight: str) -> str:
    def total(e: str) -> str:
        return f"sum({e}){over}"

    first = [total("p - y"), *[f"{total(f'(p - y) * x{i}')} + {weight.format(i)}" for i in (1, 2)]]
    names = {"00": "1", "01": "x1", "02": "x2", "11": "x1 * x1", "12": "x1 * x2", "22": "x2 * x2"}
    second = [f"{total(f'p * (1 - p) * {e}')}{' + 1' * (n in ('11', '22'))} AS h{n}" for n, e in names.items()]
    return ", ".join([f"{e} AS g{i}" for i, e in enumerate(first)] + second)


def _newton(train: str, scored: str) -> str:
    """``fit`` on the rows of ``plane`` that meet a condition, and ``scored``, a query of plane and the last step."""
    return f"""{PLANE}, fit AS (
  SELECT 0 AS step, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2
  UNION ALL
  SELECT step + 1, b0 - {MOVES[0]}, b1 - {MOVES[1]}, b2 - {MOVES[2]}
  FROM (SELECT *, {DET} AS det FROM (
    SELECT any_value(step) AS step, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {_derivatives("", "any_value(b{0})")}
    FROM (SELECT *, {ODDS} AS p FROM fit, plane WHERE step < 25 AND {train}))) WHERE step IS NOT NULL),
scored AS ({scored} FROM (SELECT *, {ODDS} AS p FROM plane, fit WHERE step = 25))"""


NEWTON = _newton("row_id % 2 = 0", "SELECT row_id, y AS label, p") + ", unseen AS (SELECT * FROM scored WHERE row_id % 2 = 1)"

# 25 steps, then rows that are sure move to the training rows; until fewer than 5 do or none is left
SELF_TRAIN = f"""{PLANE}, loop AS (
  SELECT 1 AS step, row_id, x1, x2, CASE WHEN row_id % 2 = 0 THEN y END AS y, CASE WHEN row_id % 2 = 0 THEN 'train' ELSE 'pool' END AS origin,
    0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, false AS done FROM plane
  UNION ALL
  SELECT step + 1, row_id, x1, x2, CASE WHEN moves THEN (p > 0.5)::INTEGER ELSE y END, CASE WHEN moves THEN 'pseudo' ELSE origin END,
    {", ".join(f"CASE WHEN step % 26 = 0 THEN b{i} ELSE b{i} - {m} END" for i, m in enumerate(MOVES))},
    step % 26 = 0 AND (count(*) FILTER (moves) OVER () < 5 OR count(*) FILTER (origin = 'pool' AND NOT moves) OVER () = 0)
  FROM (SELECT *, {DET} AS det, step % 26 = 0 AND origin = 'pool' AND greatest(p, 1 - p) > 0.55 AS moves FROM (
    SELECT *, {_derivatives(" FILTER (origin <> 'pool') OVER ()", "b{0}")} FROM (SELECT *, {ODDS} AS p FROM loop WHERE NOT done))))"""

SUMMED = "sum((tp + fn) * f1) / sum(tp + fn)"
ACC = "sum(tp) / sum(tp + fn)::DOUBLE"
F1_ONE = "coalesce(max(f1) FILTER (cls = 1), 0)"
ROC_ONE = "max(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 END) FILTER (cls = 1)"

ORACLE: dict[str, str] = {
    # sources and sinks
    "read_jsonl": _with(PAIRS, "SELECT context, target, label FROM pairs"),
    "read_annotated_csv": _with(ANNOTATED, "SELECT row_id, context, target, annotation AS label FROM annotated"),
    "read_csv_splits": _with(PAIRS, f"SELECT context || ' [SEP] ' || target AS all_text, CAST(label AS INTEGER) AS label, {SPLIT} AS split FROM pairs"),
    "read_tiered": _with(PAIRS, f"SELECT context, target, label, tier, {SPLIT} AS split FROM pairs"),
    "write_artifact": _with(BINARY_PAIRS, "SELECT tier, label, count(*) AS n FROM twoclass GROUP BY ALL"),
    "read_artifact": _with(LOGITS, "SELECT row_id, y_true, y_pred FROM scored"),
    "materialize_if_absent": "SELECT doc_id AS row_id, toxic AS label FROM labels",
    "recipe_store": _with(PAIRS, "SELECT row_id, CAST(label AS INTEGER) AS label, tier, CAST(3 AS INTEGER) AS num_label, CAST(0.25 AS DOUBLE) AS null_ratio FROM pairs WHERE tier = 'gold'"),
    # projections
    "pair_text": _with(PAIRS, "SELECT row_id, context || ' [SEP] ' || target AS text FROM pairs"),
    "drop_columns": _with(PAIRS, "SELECT row_id, label, tier FROM pairs"),
    "label_to_int": _with(DOCLABELS, "SELECT row_id, label FROM doclabels"),
    "binarize_01": _with(DOCLABELS, "SELECT row_id, CASE WHEN label IN (0, 1) THEN 0 ELSE 1 END AS label FROM doclabels"),
    "merge_neutral": _with(DOCLABELS, "SELECT row_id, CASE WHEN label = 1 THEN 0 ELSE label END AS label FROM doclabels"),
    "letter_label": _with(ANNOTATED, "SELECT row_id, CASE WHEN annotation IN ('h', 'n') THEN 0 ELSE 1 END AS label FROM annotated"),
    "select_model_columns": _with(BINARY_PAIRS, "SELECT row_id, target, label FROM twoclass"),
    "softmax": _with(LOGITS, _long("scored", ["p0", "p1", "p2"], "prob")),
    "argmax_label": _with(LOGITS, "SELECT row_id, y_pred FROM scored"),
    "confidence": _with(LOGITS, "SELECT row_id, round(greatest(p0, p1, p2), 6) AS conf FROM scored"),
    "one_hot": _with(LOGITS, _long("scored", [f"CASE WHEN y_true = {i} THEN 1.0::DOUBLE ELSE 0.0 END" for i in range(3)], "value", "row_id, y_true AS back")),
    "class_at": _with(LOGITS, "SELECT row_id, CAST(10 * (y_pred + 1) AS INTEGER) AS cls FROM scored"),
    "format_elapsed": _with(STEPS + ", totals AS (SELECT run, sum(seconds) AS s FROM steps GROUP BY run)", f"SELECT run, {_elapsed('s')} AS took FROM totals"),
    "normalize_scores": _with(
        LOGITS + ", absolute AS (SELECT row_id, abs(x0) AS a0, abs(x1) AS a1, abs(x2) AS a2 FROM logits)",
        _long("absolute", [f"CASE WHEN row_id % 7 = 0 THEN 0.0::DOUBLE ELSE a{i} / (a0 + a1 + a2) END" for i in range(3)], "share"),
    ),
    # encoding
    "build_vocab": _with(_vocab("SELECT text FROM documents", 50000), "SELECT token, n, id FROM vocab"),
    "encode_text": _with(f"{TEXTS}, {_vocab('SELECT text FROM texts')}, " + _encode_text("texts", "text"), ""),
    "encode_documents": _with(f"docs AS (SELECT doc_id AS row_id, text FROM documents), {_vocab('SELECT text FROM documents')}, " + _encode_text("docs", "text"), ""),
    "encode_pair": _with(f"{PAIRS}, {PAIR_VOCAB}, {_pair_frame('pairs', 512)}", f"SELECT row_id, {_padded('full_ids', '512')} FROM framed"),
    "encode_pair_truncated": _with(f"{PAIRS}, {PAIR_VOCAB}, {_pair_frame('pairs', 96)}", f"SELECT row_id, {_padded('full_ids', '96')} FROM framed"),
    "pair_truncation": _with(
        f"{PAIRS}, sized AS (SELECT row_id, CAST(len({_tokens('target')}) AS INTEGER) AS la, CAST(len({_tokens('context')}) AS INTEGER) AS lb FROM pairs), "
        "cut AS (SELECT *, CASE WHEN la + lb <= 101 THEN lb ELSE least(lb, greatest(101 - la, 50)) END AS kb FROM sized)",
        "SELECT row_id, la, lb, CAST(CASE WHEN la + lb <= 101 THEN la ELSE 101 - kb END AS INTEGER) AS kept_first, CAST(kb AS INTEGER) AS kept_second FROM cut",
    ),
    "pad_and_mask": _with(f"{PAIRS}, {_vocab('SELECT target AS text FROM pairs')}, {_ids('pairs', 'target', 14, 'enc')}", f"SELECT row_id, {_padded('ids', '16')} FROM enc"),
    "unknown_share": _with(
        _vocab("SELECT text FROM documents") + f", turns AS (SELECT unnest({_tokens('text')}[1:510]) AS token FROM conversations)",
        "SELECT round(count(*) FILTER (id IS NULL) / count(*)::DOUBLE, 6) AS unknown_share FROM turns LEFT JOIN vocab USING (token)",
    ),
    "embed_rows_model": _with(
        f"{PAIRS}, {PAIR_VOCAB}, {_pair_frame('pairs', 128)}",
        "SELECT row_id, CAST(list_sum(full_ids) % 1000 AS INTEGER) AS total, CAST(len(full_ids) AS INTEGER) AS n FROM framed",
    ),
    "dynamic_pad": _with(f"items AS (SELECT item_id AS row_id, text FROM benchmark), {_vocab('SELECT text FROM benchmark')}, " + _encode_text("items", "text", pad="longest"), ""),
    "pack_features": "SELECT vec_id AS row_id, CAST(label >= 5 AS INTEGER) AS label, CAST(len(embedding) AS INTEGER) AS width, "
                     "round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings",
    # filters, joins, unions
    "silver_minority_only": _with(PAIRS, "SELECT row_id, tier, label FROM pairs WHERE tier = 'gold' OR label = '2'"),
    "label_isin": _with(ANNOTATED, "SELECT row_id, annotation FROM annotated WHERE annotation <> 'other'"),
    "class_partition": "SELECT doc_id AS row_id, toxic AS label FROM labels WHERE toxic = 1",
    "confident_rows": _with(LOGITS, "SELECT row_id, y_pred FROM scored WHERE greatest(p0, p1, p2) > 0.8"),
    "attach_predictions": _with(LOGITS, "SELECT row_id, y_true, y_pred FROM scored"),
    "take_indices": _with(LOGITS, "SELECT row_id, y_true FROM scored WHERE greatest(p0, p1, p2) > 0.8"),
    "remaining_rows": _with(LOGITS, "SELECT row_id, y_true FROM scored WHERE NOT greatest(p0, p1, p2) > 0.8"),
    "consecutive_pairs": "SELECT b.conv_id, b.turn, a.text AS context, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1",
    "union_tiers": _with(PAIRS, "SELECT row_id, tier, label FROM pairs"),
    "append_pseudo_labels": _with(LOGITS, "SELECT row_id, y_true AS label, 'train' AS origin FROM scored WHERE row_id % 2 = 0 UNION ALL SELECT row_id, y_pred, 'pseudo' FROM scored WHERE row_id % 2 = 1 AND greatest(p0, p1, p2) > 0.8"),
    "with_row_id": """WITH rows AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, md5('1:' || length(event_type) || ':' || event_type || '1:' || length(hour(ts)::VARCHAR) || ':' || hour(ts)) AS digest FROM events)
SELECT digest || '-' || (row_number() OVER (PARTITION BY digest) - 1) AS row_id, event_type, hour FROM rows""",
    # sampling and ordering
    "upsample_to_majority": _with(f"{IMBALANCED}, {_upsample('imbalanced', 'row_id', 'n0', 'row_id, label')}", "SELECT row_id, label, draw_no FROM ups"),
    "upsample_by_factor": _with(f"{IMBALANCED}, {_upsample('imbalanced', 'row_id', 'round_even(1.3::DOUBLE * n1, 0)', 'row_id, label')}", "SELECT row_id, label, draw_no FROM ups"),
    "upsample_poisson": _with(
        f"""{IMBALANCED}, rate AS (SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1)::DOUBLE AS r FROM imbalanced),
mass AS (SELECT i, exp(i * ln(r) - r - lgamma(i + 1)) AS m FROM (SELECT r, unnest(range(200)) AS i FROM rate)),
ladder AS (SELECT i, sum(m) OVER (ORDER BY i) AS step FROM mass),
drawn AS (SELECT row_id, label, {_number(_hash('123:poisson', 'row_id'), 13)} / pow(16.0::DOUBLE, 13) AS u FROM imbalanced WHERE label = 1),
copies AS (SELECT row_id, label, count(*) AS n FROM drawn JOIN ladder ON step <= u GROUP BY ALL)""",
        "SELECT row_id, label, CAST(-1 AS BIGINT) AS draw_no FROM imbalanced WHERE label = 0 UNION ALL SELECT row_id, label, unnest(range(n)) FROM copies",
    ),
    "inject_null_context": _with(
        f"{PAIRS}, ranked AS (SELECT *, row_number() OVER (ORDER BY {_hash(123, 'row_id')}, row_id) AS place FROM pairs)",
        "SELECT row_id, CASE WHEN place <= floor(0.25 * (SELECT count(*) FROM pairs)) THEN '' ELSE context END AS context FROM ranked",
    ),
    "shuffle_rows": f"SELECT event_id AS row_id, user_id AS run, row_number() OVER (ORDER BY {_hash(123, 'event_id')}, event_id) - 1 AS position FROM events",
    "random_split": _with(STEPS, f"SELECT row_id, {SPLIT} AS split FROM steps"),
    "batch_ids": "SELECT event_id AS row_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 32) AS BIGINT) AS batch_id FROM events",
    "batch_ids_text_key": """WITH keyed AS (SELECT event_type, hour(ts) AS h, md5('1:' || length(event_type) || ':' || event_type || '1:' || length(hour(ts)::VARCHAR) || ':' || hour(ts)) AS digest FROM events),
numbered AS (SELECT digest || '-' || (row_number() OVER (PARTITION BY digest) - 1) AS row_id FROM keyed)
SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 32) AS BIGINT) AS batch_id FROM numbered""",
    "batch_ids_random": f"SELECT event_id AS row_id, CAST(floor((row_number() OVER (ORDER BY {_hash(123, 'event_id')}, event_id) - 1) / 32) AS BIGINT) AS batch_id FROM events",
    "steps_per_epoch": "SELECT count(*) // 8 AS steps FROM events",
    "global_index": "SELECT ts, event_id AS row_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events",
    "global_index_ties": "SELECT event_id % 3 AS part, event_id AS row_id, row_number() OVER (ORDER BY event_id % 3, event_id) - 1 AS position FROM events",
    "running_sum": "SELECT event_id AS row_id, row_number() OVER w AS step, round(sum(value) OVER w, 4) AS running_loss FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "running_sum_by_run": "SELECT user_id AS run, event_id AS row_id, row_number() OVER w AS step, round(sum(value) OVER w, 4) AS running_loss FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "exact_k_by_hash": f"SELECT row_id FROM (SELECT event_id AS row_id, row_number() OVER (ORDER BY {_hash(7, 'event_id')}, event_id) AS place FROM events) WHERE place <= (SELECT count(*) // 3 FROM events)",
    "best_so_far": _with(BEST, "SELECT run, row_id, loss, saved FROM flagged"),
    "select_checkpoint": _with(BEST, "SELECT run, row_id, loss FROM flagged WHERE saved QUALIFY row_number() OVER (PARTITION BY run ORDER BY row_id DESC) = 1"),
    # evaluation
    "row_count": _with(PAIRS, "SELECT tier, count(*) AS n FROM pairs GROUP BY tier"),
    "distinct_classes": _with(DOCLABELS, "SELECT DISTINCT CAST(label AS VARCHAR) AS cls FROM doclabels"),
    "prediction_distribution": _with(LOGITS, "SELECT CAST(c AS INTEGER) AS cls, round((SELECT count(*) FROM scored WHERE y_pred = c) / (SELECT count(*) FROM scored)::DOUBLE, 6) AS share FROM (SELECT unnest(range(4)) AS c)"),
    "confusion_counts": _with(LOGITS + ", classes AS (SELECT DISTINCT y_true AS c FROM scored UNION SELECT DISTINCT y_pred FROM scored)", "SELECT t.c AS y_true, p.c AS y_pred, (SELECT count(*) FROM scored WHERE y_true = t.c AND y_pred = p.c) AS n FROM classes t, classes p"),
    "confusion_joint_T": _with(LOGITS + ", classes AS (SELECT DISTINCT y_true AS c FROM scored UNION SELECT DISTINCT y_pred FROM scored)", "SELECT t.c AS y_true, p.c AS y_pred, round((SELECT count(*) FROM scored WHERE y_true = t.c AND y_pred = p.c) / (SELECT count(*) FROM scored)::DOUBLE, 6) AS share FROM classes t, classes p"),
    "confusion_row_normalized": _with(LOGITS + ", classes AS (SELECT DISTINCT y_true AS c FROM scored UNION SELECT DISTINCT y_pred FROM scored)", "SELECT t.c AS y_true, p.c AS y_pred, round(coalesce((SELECT count(*) FROM scored WHERE y_true = t.c AND y_pred = p.c) / nullif((SELECT count(*) FROM scored WHERE y_true = t.c), 0)::DOUBLE, 0), 6) AS share FROM classes t, classes p"),
    "one_vs_rest_counts": _with(f"{LOGITS}, {RATES}", "SELECT cls, tp, fp, tn, fn FROM rates"),
    "precision_recall_f1_accuracy": _with(f"{LOGITS}, {RATES}", "SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM rates"),
    "accuracy": _with(LOGITS, "SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM scored"),
    "weighted_f1": _with(f"{LOGITS}, {RATES}", f"SELECT round({SUMMED}, 6) AS weighted_f1 FROM rates"),
    "binary_f1": _with(f"{FLAGS}, {RATES}", f"SELECT round({F1_ONE}, 6) AS f1 FROM rates"),
    "cohen_kappa": _with(f"{LOGITS}, {RATES}", f"SELECT round({KAPPA}, 6) AS cohen_kappa"),
    "roc_auc_hard": _with(f"{FLAGS}, {RATES}", f"SELECT round({ROC_ONE}, 6) AS roc_auc FROM rates"),
    "roc_auc_scores": _with(
        DOCLABELS + """, per AS (SELECT n_chars, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true <> 1) AS neg FROM doclabels GROUP BY n_chars),
below AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM per)""",
        "SELECT round(sum(pos * (less + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc FROM below",
    ),
    "percent_accuracy": _with(FLAGS, "SELECT round(100 * avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS percent_accuracy FROM scored"),
    "cross_entropy": _with(LOGITS, "SELECT round(avg(lse - CASE y_true WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END), 6) AS cross_entropy FROM scored"),
    "cross_entropy_double_softmax": _with(LOGITS, "SELECT round(avg(ln(exp(p0) + exp(p1) + exp(p2)) - CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END), 6) AS cross_entropy FROM scored"),
    "binary_cross_entropy": _with(
        LOGITS + ", terms AS (" + " UNION ALL ".join(f"SELECT y_true = {i} AS t, p{i} AS p FROM scored" for i in range(3)) + ")",
        "SELECT round(avg(-greatest(CASE WHEN t THEN CASE WHEN p <= 0 THEN -100 ELSE ln(p) END ELSE CASE WHEN 1 - p <= 0 THEN -100 ELSE ln(1 - p) END END, -100)), 6) AS binary_cross_entropy FROM terms",
    ),
    "batch_mean_metric": _with(BATCHED, "SELECT round(avg(m), 6) AS accuracy FROM (SELECT avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS m FROM batched GROUP BY batch_id)"),
    "batch_mean_f1": _with(
        BATCHED + ", per AS (SELECT count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_pred = 1) AS called, count(*) FILTER (y_true = 1) AS support FROM batched GROUP BY batch_id)",
        "SELECT round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (called + support) END), 6) AS f1 FROM per",
    ),
    "batch_mean_report": _with(
        BATCHED + """, per AS (SELECT CASE WHEN row_id % 2 = 0 THEN 'train' ELSE 'valid' END AS phase, batch_id,
  avg(ln(exp(p0) + exp(p1)) - CASE y_true WHEN 0 THEN p0 ELSE p1 END) AS loss, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy, """
        + ", ".join(
            f"count(*) FILTER (y_true = {c} AND y_pred = {c})::DOUBLE AS tp{c}, count(*) FILTER (y_pred = {c}) AS called{c}, count(*) FILTER (y_true = {c}) AS support{c}"
            for c in (0, 1)
        ) + " FROM batched GROUP BY ALL)",
        "SELECT phase, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy, " + ", ".join(
            f"round(avg(coalesce(tp{c} / nullif(called{c}, 0), 0)), 6) AS precision_{c}, round(avg(coalesce(tp{c} / nullif(support{c}, 0), 0)), 6) AS recall_{c}, "
            f"round(avg(coalesce(2 * tp{c} / nullif(called{c} + support{c}, 0), 0)), 6) AS f1_{c}" for c in (0, 1)
        ) + " FROM per GROUP BY phase",
    ),
    "loss_over_dataset": _with(
        LOGITS + ", batched AS (SELECT lse - CASE y_true WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS loss, floor((row_number() OVER (ORDER BY row_id) - 1) / 32) AS b FROM scored)",
        "SELECT round(sum(m) / sum(n), 6) AS loss FROM (SELECT avg(loss) AS m, count(*) AS n FROM batched GROUP BY b)",
    ),
    "majority_baseline": _with(DOCLABELS, "SELECT label AS cls, round(count(*) / (SELECT count(*) FROM doclabels)::DOUBLE, 6) AS accuracy FROM doclabels GROUP BY label ORDER BY count(*) DESC, label LIMIT 1"),
    "metric_report": _with(f"{LOGITS}, {RATES}", f"SELECT round({ACC}, 6) AS accuracy, round({SUMMED}, 6) AS f1 FROM rates"),
    "metric_report_binary": _with(f"{FLAGS}, {RATES}", f"SELECT round({KAPPA}, 6) AS cohen_kappa, round({F1_ONE}, 6) AS f1, round({ROC_ONE}, 6) AS roc_auc FROM rates"),
    "metric_report_loss": _with(
        f"{BATCHED}, {RATES}, losses AS (SELECT avg(ln(exp(p0) + exp(p1)) - CASE y_true WHEN 0 THEN p0 ELSE p1 END) AS m, count(*) AS n FROM batched GROUP BY batch_id)",
        f"SELECT (SELECT round(sum(m) / sum(n), 6) FROM losses) AS loss, round({ACC}, 6) AS accuracy, round({F1_ONE}, 6) AS f1, round({ROC_ONE}, 6) AS roc_auc FROM rates",
    ),
    "epoch_stats": _with(f"{STEPS}, {_stats()}", "SELECT epoch, round(train_loss, 6) AS train_loss, round(valid_loss, 6) AS valid_loss, round(valid_accuracy, 6) AS valid_accuracy, train_time, valid_time FROM stats"),
    "rows_to_series": _with(f"{STEPS}, {_stats()}", " UNION ALL ".join(f"SELECT '{k}' AS key, epoch, round({k}, 6) AS value FROM stats WHERE {k} IS NOT NULL" for k in ("train_loss", "valid_loss", "valid_accuracy"))),
    "epoch_series": _with(f"{STEPS}, {_stats()}", "SELECT epoch, round(valid_accuracy, 6) AS valid_accuracy FROM stats"),
    # label shift
    "shift_weights": _with(WEIGHTS, " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS cls, round(w{i}, 6) AS w, false AS degenerate FROM solved" for i in range(3))),
    "shift_weights_binary": _with(BINARY_WEIGHTS, " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS cls, round(w{i}, 6) AS w, degenerate FROM solved" for i in range(2))),
    "shift_weights_degenerate": "SELECT DISTINCT toxic AS cls, 0.0::DOUBLE AS w, true AS degenerate FROM labels WHERE doc_id % 2 = 0",
    "clip_negative": "SELECT label AS cls, round(greatest(avg(CAST(embedding[1] AS DOUBLE)), 0), 6) AS w FROM embeddings GROUP BY label",
    "apply_class_weights": _with(WEIGHTS, _long("test, solved", ["w0 * p0", "w1 * p1", "w2 * p2"], "value")),
    "adjust_probs": _with(ADJUSTED, _long("adjusted", ["a0", "a1", "a2"], "prob")),
    "update_probs": _with(ADJUSTED, "SELECT row_id, y_pred, CAST(CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS INTEGER) AS new_pred FROM adjusted"),
    "shift_corrected_evaluation": _with(BINARY_WEIGHTS + CORRECTED, BEFORE_AND_AFTER),
    # learning, given scores
    "self_train_step": _with(
        LOGITS + ", sure AS (SELECT *, greatest(p0, p1, p2) > 0.8 AS moved FROM scored WHERE row_id % 2 = 1), verdict AS (SELECT count(*) FILTER (moved) < 50 AS converged FROM sure), "
        "rows AS (SELECT row_id, y_true AS label, 'train' AS origin FROM scored WHERE row_id % 2 = 0 UNION ALL "
        "SELECT row_id, CASE WHEN moved THEN y_pred ELSE -1 END, CASE WHEN moved THEN 'pseudo' ELSE 'pool' END FROM sure)",
        "SELECT row_id, CAST(label AS INTEGER) AS label, origin, converged FROM rows, verdict",
    ),
    # learning: properties that hold for the right model and no other, or for any model, over unseen rows
    "fit_linear_probe": _slopes([1], 64),
    "two_phase_fit": f"SELECT phase::INTEGER AS phase, s.* FROM (SELECT unnest([1, 2]) AS phase), ({_slopes([0, 1, 2], 64)}) s",
    "two_phase_fit_weighted": _slopes([0, 1, 2], 64),
    "two_phase_fit_held_out": "SELECT vec_id AS row_id, CAST(label % 3 AS INTEGER) AS label, CAST(3 AS INTEGER) AS k, 1.0::DOUBLE AS total, true AS best FROM embeddings WHERE vec_id % 3 = 2",
    "transfer_fit": _slopes([1], 67),
    "transfer_fit_held_out": _unseen("vec_id % 3 = 2"),
    "fit_mlp_head": f"SELECT *, 0.0::DOUBLE AS bias FROM ({_unseen('vec_id % 2 = 1')})",
    "predict": _with("RECURSIVE " + NEWTON, "SELECT row_id, label, (p > 0.5)::INTEGER AS prediction FROM unseen"),
    "predict_proba": _with("RECURSIVE " + NEWTON, "SELECT row_id, 0::INTEGER AS pos, round(1 - p, 6) AS prob FROM unseen UNION ALL SELECT row_id, 1, round(p, 6) FROM unseen"),
    "fit_text_classifier": _with(DOCLABELS, "SELECT row_id, label, CAST(3 AS INTEGER) AS k, 1.0::DOUBLE AS total, true AS best, 0.0::DOUBLE AS bias, true AS beats_majority FROM doclabels WHERE row_id % 2 = 1"),
    "train_and_correct": _with(
        # validation rows get even numbers, test rows odd ones
        "RECURSIVE " + _newton("row_id % 3 = 0", "SELECT 2 * row_id + (row_id % 3 = 2)::INTEGER AS row_id, row_id % 3 AS third, y AS y_true, (p > 0.5)::INTEGER AS y_pred, 1 - p AS p0, p AS p1")
        .replace("scored AS", "thirds AS") + ", scored AS (SELECT * FROM thirds WHERE third > 0), " + WEIGHTS_OF_TWO + CORRECTED, BEFORE_AND_AFTER,
    ),
    "self_train": _with("RECURSIVE " + SELF_TRAIN, "SELECT row_id, y AS label, origin, (step // 26)::INTEGER AS rounds, done AS converged FROM loop WHERE done"),
    # recipes
    "prepare_splits": _prepare_splits(),
    "prepare": f"SELECT * FROM ({_prepare('gold')}) UNION ALL SELECT * FROM ({_prepare('silver')})",
    "prepared_recipes": _with(
        BINARY_PAIRS,
        "SELECT tier, 2::INTEGER AS num_label, false AS upsampled, label, count(*) AS n, 64 * count(*) AS ids FROM twoclass GROUP BY tier, label",
    ),
    "prepare_gold_silver": _with(BINARY_PAIRS, "SELECT row_id, tier, label FROM twoclass"),
    "prepare_minority_boost": _with(
        BINARY_PAIRS + ", boosted AS (SELECT * FROM twoclass WHERE tier = 'gold' OR label = 1), " + _upsample("boosted", "row_id", "round_even(1.3::DOUBLE * n1, 0)", "row_id, tier, label"),
        "SELECT row_id, tier, label, draw_no FROM ups",
    ),
    "prepare_annotated_test": _with(ANNOTATED, "SELECT row_id, CASE WHEN annotation = 'c' THEN 1 ELSE 0 END AS label FROM annotated WHERE annotation <> 'other'"),
}
ORACLE["encode_text_by_join"] = ORACLE["encode_text"]
ORACLE["read_records"] = "SELECT doc_id, length(text)::INTEGER AS length, md5(text) AS digest, source FROM documents"
ORACLE["embed_rows"] = f"""WITH {TEXTS},
terms AS (SELECT row_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 768 AS slot, count(*) AS tf
  FROM (SELECT row_id, unnest({_tokens('text')}) AS token FROM texts) GROUP BY ALL),
idf AS (SELECT slot, ln(((SELECT count(*) FROM texts) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM terms GROUP BY slot),
vectors AS (SELECT row_id, slot, (tf * idf)::FLOAT::DOUBLE AS v FROM terms JOIN idf USING (slot))
SELECT row_id, 768::INTEGER AS width, round(sqrt(coalesce(sum(v * v), 0)), 6) AS norm,
  {', '.join(f"round(coalesce(max(v) FILTER (slot = {i}), 0), 6) AS slot_{i}" for i in (0, 300, 767))}
FROM texts LEFT JOIN vectors USING (row_id) GROUP BY row_id"""
ORACLE["best_so_far_stream"] = ORACLE["best_so_far"]
ORACLE["epoch_stats_stream"] = ORACLE["epoch_stats"]

"""The SQL that states each query's result independently, for DuckDB.

These use plain windows, global sorts and range joins on purpose: they say what
is computed, while the queries say how to compute it on many executors.
"""

from __future__ import annotations

# every character a text strip removes
SPACE = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def h60(*parts: str, start: int = 1) -> str:
    """60-bit hash of '|'-joined parts."""
    text = "||'|'||".join(parts)
    return f"cast('0x'||substr(md5({text}), {start}, 15) as bigint)"


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) + 0.0 as {alias}"


PAIRS = """
    pairs as (
        select cast(l_partkey as varchar) as left_id, cast(l_suppkey as varchar) as right_id from lineitem
    ),
    positives as (select distinct left_id, right_id from pairs)"""

STRONG = """
    strong as (
        select cast(l_partkey as varchar) as left_id, cast(l_suppkey as varchar) as right_id
        from lineitem where l_quantity > 40
    )"""

WEAK = """
    weak as (
        select cast(l_partkey as varchar) as left_id, cast(l_suppkey as varchar) as right_id
        from lineitem where l_quantity <= 40
    )"""

LABELLED = f"""{PAIRS}, {STRONG},
    labelled as (
        select distinct left_id, right_id, 1 as label from strong
        union all
        select left_id, right_id, 0 as label from positives p
        where not exists (select 1 from strong s where s.left_id = p.left_id and s.right_id = p.right_id)
    )"""

SPLIT = f"""{LABELLED},
    split as (
        select left_id, right_id, label, cast(ntile(5) over (
            order by {h60("'42'", 'left_id', 'right_id', 'label')}, left_id, right_id, label) - 1 as integer) as fold
        from labelled
    )"""


def entities(source: str, seed) -> str:
    return f"""
    ids as (
        select 'left' as side, left_id as id from {source} union select 'right', right_id from {source}
    ),
    entities as (
        select side, id, row_number() over (partition by side order by {h60(f"'{seed}'", 'id', "'id'")}, id) - 1 as idx
        from (select * from ids)
    )""".replace(h60(f"'{seed}'", "id", "'id'"), f"cast('0x'||substr(md5('{seed}|'||id), 1, 15) as bigint)")


def draws(attempts: str, seed) -> str:
    return f"""
    sizes as (
        select count(*) filter (where side = 'left') as nl, count(*) filter (where side = 'right') as nr from entities
    ),
    attempts as (select unnest(range({attempts})) as attempt),
    drawn as (
        select attempt,
               {h60(f"'{seed}'", 'attempt')} % nl as li,
               {h60(f"'{seed}'", 'attempt', start=16)} % nr as ri
        from attempts, sizes
    ),
    draws as (
        select attempt, l.id as left_id, r.id as right_id
        from drawn
        join entities l on l.side = 'left' and l.idx = li
        join entities r on r.side = 'right' and r.idx = ri
    )"""


def negatives(source: str, seed, wanted: str) -> str:
    """Accept in attempt order, at most 100 attempts per wanted pair."""
    return f"""{entities(source, seed)},
    goal as (select {wanted} as n),
    {draws('(select 100 * n from goal)', seed)},
    accepted as (
        select left_id, right_id, min(attempt) as attempt from draws d
        where not exists (select 1 from {source} p where p.left_id = d.left_id and p.right_id = d.right_id)
        group by left_id, right_id
    ),
    negatives as (select * from accepted order by attempt limit (select n from goal))"""


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

SCORED = """
    scored as (
        select cast(l_partkey as varchar) as left_id, cast(l_suppkey as varchar) as right_id,
               l_linenumber - 1 as fold,
               cast(l_quantity + 120.0 * l_discount > 31 as integer) as label,
               (l_quantity + 30.0 * l_tax + l_extendedprice / 4000.0)
               / (l_quantity + 30.0 * l_tax + l_extendedprice / 4000.0 + 38.0) as score
        from lineitem
    )"""

TIES = """
    scored as (
        select cast(doc_id % 3 as integer) as fold, quality as label,
               cast(floor(least(n_chars, 20000) / 500.0) as double) / cast(40 as double) as score
        from labels join documents using (doc_id)
    )"""

HISTORY = """
    history as (
        select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as epoch,
               value / (value + 50.0) as auc
        from events
    )"""

LONG_HISTORY = """
    history as (
        select l_suppkey as run_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as epoch,
               row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) / 1000.0 as auc
        from lineitem
    )"""

NAN_HISTORY = """
    history as (
        select run_id, epoch, case when epoch % 3 = 2 then 'nan'::double else auc end as auc
        from (
            select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as epoch,
                   value / (value + 50.0) as auc
            from events
        )
    )"""

VECTORS = f"""
    v as (
        select {KEYS}, l_quantity as a0, l_extendedprice / 1000.0 as a1, l_discount * 100.0 as b0, l_quantity as b1,
               l_tax * 100.0 as c0, l_discount as c1
        from lineitem
    )"""

STEPS = """
    counts as (
        select fold, score, cast(sum(label) as double) as p, cast(sum(1 - label) as double) as n
        from scored group by fold, score
    ),
    steps as (
        select *, sum(p) over w as tp, sum(n) over w as fp,
               sum(p) over (partition by fold) as pos, sum(n) over (partition by fold) as neg
        from counts window w as (partition by fold order by score desc)
    )"""

METRIC_ROWS = f"""{STEPS},
    ranked as (
        select fold, sum(n * (tp - p / 2)) / nullif(max(pos) * max(neg), 0) as auc_roc,
               sum(p / nullif(pos, 0) * tp / (tp + fp)) as pr_auc
        from steps group by fold
    ),
    cells as (
        select fold,
               count(*) filter (where label = 0 and score <= 0.5) as tn,
               count(*) filter (where label = 0 and score > 0.5) as fp,
               count(*) filter (where label = 1 and score <= 0.5) as fn,
               count(*) filter (where label = 1 and score > 0.5) as tp,
               avg(-ln(greatest(1e-15::double, least(1 - 1e-15::double, case when label = 1 then score else 1 - score end))))
                   as loss
        from scored group by fold
    ),
    rates as (
        select fold, tn, fp, fn, tp, loss,
               (tn + tp) / cast(tn + fp + fn + tp as double) as accuracy,
               coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as precision,
               coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall,
               coalesce(2 * tp / nullif(cast(2 * tp + fp + fn as double), 0), 0) as f1
        from cells
    ),
    evaluated as (select * from rates join ranked using (fold))"""

LONG = f"""{METRIC_ROWS},
    long as (
        select fold, unnest(['accuracy', 'auc_roc', 'pr_auc', 'f1', 'precision', 'recall']) as metric,
               unnest([accuracy, auc_roc, pr_auc, f1, precision, recall]) as value
        from evaluated
    )"""

EVALUATED = f"""
    select fold, {', '.join(r6(c, c) for c in ('accuracy', 'auc_roc', 'pr_auc', 'f1', 'precision', 'recall', 'loss'))},
           tn, fp, fn, tp
    from evaluated"""


def points(kind: str) -> str:
    x, y, start = ("fp / neg", "tp / pos", 0) if kind == "roc" else ("tp / pos", "tp / (tp + fp)", 1)
    return f"""{STEPS},
    points as (
        select fold, score as threshold, {x} as x, {y} as y from steps
        union all
        select distinct fold, cast(null as double), cast(0 as double), cast({start} as double) from scored
    )"""


def grid(kind: str) -> str:
    """Linear reading at 100 even x values by a range join on the curve's segments."""
    last, first = ("max", "min") if kind == "roc" else ("min", "max")
    forced = "case when i = 0 then 0.0 else y end" if kind == "roc" else "y"
    return f"""{points(kind)},
    knots as (select fold, x, {last}(y) as y_out, {first}(y) as y_in from points group by fold, x),
    segments as (
        select fold, x as x0, y_out as y0, lead(x) over w as x1, lead(y_in) over w as y1
        from knots window w as (partition by fold order by x)
    ),
    marks as (
        select cast(i as integer) as i, case when i = 99 then cast(1 as double) else i * (cast(1 as double) / 99) end as gx
        from range(100) t(i)
    ),
    read as (
        select fold, i, gx as x,
               case when x1 is null or x0 = gx then y0 else (y1 - y0) / (x1 - x0) * (gx - x0) + y0 end as y
        from segments join marks on gx >= x0 and (x1 is null or gx < x1)
    ),
    grid as (select fold, i, x, {forced} as y from read)"""


def mean_curve(kind: str) -> str:
    mean = "case when i = 99 then 1.0 else avg(y) end" if kind == "roc" else "avg(y)"
    return f"""{grid(kind)},
    mean_grid as (select i, max(x) as x, {mean} as mean, stddev_pop(y) as std from grid group by i)"""


MEAN_OUT = (
    f"select i, {r6('mean', 'mean')}, {r6('std', 'std')}, {r6('greatest(mean - std, 0.0)', 'lower')}, "
    f"{r6('least(mean + std, 1.0)', 'upper')} from mean_grid"
)


def area(source: str, y: str, by: str = "") -> str:
    over = f"over ({'partition by ' + by if by else ''} order by i)"
    pick = f"{by}, " if by else ""
    return (
        f"select {pick}sum(piece) as area from (select {pick}(x - lag(x) {over}) * ({y} + lag({y}) {over}) / 2 as piece "
        f"from {source}) {'group by ' + by if by else ''}"
    )


def stop_states(patience: int, delta: str, better: str) -> str:
    """One row per epoch until the run stops."""
    return f"""{HISTORY},
    states as (
        select run_id, epoch, auc as best, 0 as waited, cast(null as bigint) as stop from history where epoch = 1
        union all
        select run_id, epoch, case when better then auc else best end, case when better then 0 else waited + 1 end,
               case when not better and waited + 1 >= {patience} then epoch end
        from (
            select h.run_id, h.epoch, h.auc, s.best, s.waited, {better.format(delta=delta)} as better
            from states s join history h on h.run_id = s.run_id and h.epoch = s.epoch + 1
            where s.stop is null
        )
    ),
    stops as (
        select run_id, cast(max(stop) as integer) as stop_epoch, arg_max(best, epoch) as best_score
        from states group by run_id
    )"""


BETTER_MAX = "h.auc > s.best + {delta}"
BETTER_MIN = "h.auc < s.best - {delta}"


def loss_by_fold(row: str, source: str = SCORED, reduce: str = "avg({})") -> str:
    return f"""with {source}
    select fold, {r6(reduce.format(row), 'loss')} from (select *, case when label = 1 then score else 1 - score end as pt
    from scored) group by fold"""


def onehot(entity: str, value: str, source: str) -> str:
    return f"select distinct {entity} as id, {value} as idx from {source}"


SIDE_SUMS = """
    left_on as (
        select cast(l_partkey as varchar) as left_id, count(distinct s_nationkey) as left_disease_sum
        from lineitem join supplier on l_suppkey = s_suppkey group by 1
    ),
    right_on as (
        select cast(l_suppkey as varchar) as right_id, count(distinct p_brand) as right_disease_sum
        from lineitem join part on l_partkey = p_partkey group by 1
    )"""

ASSEMBLED = f"""with {PAIRS}, {SIDE_SUMS}
    select left_id, right_id,
           cast(p_size as float) as left_seq_0, cast(p_retailprice as float) as left_seq_1,
           cast(p_retailprice as float) as left_struct_0,
           cast(left_disease_sum as double) as left_disease_sum,
           cast(s_acctbal as float) as right_seq_0, cast(s_nationkey as float) as right_seq_1,
           cast(s_acctbal as float) as right_struct_0, cast(s_nationkey as float) as right_struct_1,
           cast(right_disease_sum as double) as right_disease_sum
    from positives
    join part on cast(p_partkey as varchar) = left_id
    join supplier on cast(s_suppkey as varchar) = right_id
    join left_on using (left_id) join right_on using (right_id)"""


def pooled(names: list[str], weights: list[float]) -> str:
    total = "+".join(f"exp({w}::double)" for w in weights)
    return "(" + " + ".join(f"{n} * (exp({w}::double) / ({total}))" for n, w in zip(names, weights)) + ")"


POOL_WEIGHTS = [0.2, 1.0, 0.5]

SPLIT_SAMPLED = f"""
    known as (select distinct left_id, right_id from pairs),
    {negatives('pairs', 42, '(select count(*) from known)')},
    labelled as (
        select left_id, right_id, 1 as label from known union all select left_id, right_id, 0 from negatives
    ),
    split as (
        select left_id, right_id, label, cast(ntile(5) over (
            order by {h60("'42'", 'left_id', 'right_id', 'label')}, left_id, right_id, label) - 1 as integer) as fold
        from labelled
    )"""

BRANDED = f"""{PAIRS},
    labelled as (
        select left_id, right_id, cast(substr(p_brand, 7, 1) in ('1', '2') as integer) as label
        from positives join part on cast(p_partkey as varchar) = left_id
    ),
    split as (
        select left_id, right_id, label, cast(ntile(5) over (
            order by {h60("'42'", 'left_id', 'right_id', 'label')}, left_id, right_id, label) - 1 as integer) as fold
        from labelled
    )"""


def fold_numbers(k: int) -> str:
    """z: every pair in every run, its numbers standardised over the entities of the run's training pairs."""
    return f"""
    left_raw as (
        select cast(p_partkey as varchar) as left_id, cast(cast(p_retailprice as float) as double) as price,
               cast(p_size as double) as size from part
    ),
    right_raw as (
        select cast(s_suppkey as varchar) as right_id, cast(cast(s_acctbal as float) as double) as balance,
               cast(s_nationkey as double) as place from supplier
    ),
    runs as (select cast(unnest(range({k})) as integer) as run),
    left_stats as (
        select run, avg(price) as m0, stddev_samp(price) as s0, avg(size) as m1, stddev_samp(size) as s1
        from (select distinct run, left_id from split join runs on fold <> run) join left_raw using (left_id) group by run
    ),
    right_stats as (
        select run, avg(balance) as n0, stddev_samp(balance) as t0, avg(place) as n1, stddev_samp(place) as t1
        from (select distinct run, right_id from split join runs on fold <> run) join right_raw using (right_id) group by run
    ),
    z as materialized (
        select run, left_id, right_id, label, fold, (price - m0) / s0 as l0, (size - m1) / s1 as l1,
               (balance - n0) / t0 as r0, (place - n1) / t1 as r1
        from split join left_raw using (left_id) join right_raw using (right_id) cross join runs
        join left_stats using (run) join right_stats using (run)
    )"""


def logistic(a: str, b: str, weight: str = "1.0", steps: int = 8, ridge: float = 1e-4) -> str:
    """scored: held-out scores of a penalised logistic model of two numbers per run, by Newton steps."""
    chain = [
        f"""rows_ as materialized (select run, cast(label as double) as y, {a} as a, {b} as b, cast({weight} as double) as k from z where fold <> run),
    w0 as (select run, cast(0 as double) as u, cast(0 as double) as v, ln(sum(k * y) / sum(k * (1 - y))) as c from rows_ group by run)"""
    ]
    for i in range(steps):
        chain.append(f"""
    d{i} as (
        select run, u, v, c, sum(e * a) / sum(k) + {ridge} * u as g0, sum(e * b) / sum(k) + {ridge} * v as g1, sum(e) / sum(k) as g2,
               sum(q * a * a) / sum(k) + {ridge} as h00, sum(q * a * b) / sum(k) as h01, sum(q * a) / sum(k) as h02,
               sum(q * b * b) / sum(k) + {ridge} as h11, sum(q * b) / sum(k) as h12, sum(q) / sum(k) as h22
        from (
            select *, k * (p - y) as e, k * p * (1 - p) as q
            from (select *, 1 / (1 + exp(-(u * a + v * b + c))) as p from rows_ join w{i} using (run))
        ) group by run, u, v, c
    ),
    w{i + 1} as materialized (
        select run, u - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det as u,
               v - (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det as v,
               c - (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det as c
        from (
            select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from d{i}
        )
    )""")
    return ",".join(chain) + f""",
    scored as materialized (
        select left_id, right_id, label, fold, 1 / (1 + exp(-(u * {a} + v * {b} + c))) as score
        from z join w{steps} using (run) where run = fold
    )"""


SQL = {
    "normalise_ids": f"""
        select l_orderkey, l_linenumber,
               cast(case when l_tax = 0 then null else cast(trunc(l_extendedprice * -0.1) as bigint) end as varchar) as number,
               cast(cast(trunc(case when l_discount = 0 then -1e18::double * l_extendedprice else l_quantity end) as hugeint) as varchar) as wide,
               regexp_replace(' '||chr(9)||chr(12288)||l_returnflag||' '||l_linestatus||'  '||chr(10),
                              '^{SPACE}+|{SPACE}+$', '', 'g') as text
        from lineitem""",
    "id_losses": """
        select unnest(['part_null', 'part_nan', 'part_unfit', 'number_null', 'number_nan', 'number_unfit']) as item,
               unnest([a, 0, 0, 0, b, c]) as value
        from (
            select count(*) filter (where not coalesce(l_discount > 0, false)) as a, count(*) filter (where l_tax = 0) as b,
                   count(*) filter (where l_tax <> 0 and l_tax < 0.03) as c
            from lineitem
        )""",
    "drop_null_ids": """
        select cast(l_partkey as varchar) as left_id, cast(l_suppkey as varchar) as right_id, count(*) as n_rows
        from lineitem where l_discount > 0 and l_tax > 0 group by 1, 2""",
    "read_pairs_dedup": f"with {PAIRS} select * from positives",
    "read_features_vector": """
        select cast(doc_id as varchar) as id, cast(quality as float) as dim_0, cast(toxic as float) as dim_1 from labels""",
    "load_modalities": """
        select 'left' as side, 'seq' as modality, count(*) as entities, cast(2 as bigint) as width, round(cast(sum(quality + toxic) as double), 3) as total
        from labels
        union all
        select 'left', 'struct', count(*), 64, round(sum(list_sum(cast(embedding as double[]))), 3) from embeddings
        union all
        select 'right', 'seq', count(*), 1, round(cast(sum(length(html)) as double), 3) from pages""",
    "keep_last_features": """
        select l_partkey, l_quantity, l_extendedprice from (
            select *, row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc,
                   l_suppkey desc, l_extendedprice desc, l_quantity desc) as place from lineitem)
        where place = 1""",
    "entity_universe": f"with {PAIRS}, {entities('pairs', 42)} select side, id from ids",
    "index_entities": f"with {PAIRS}, {entities('pairs', 42)} select side, id, idx from entities",
    "dataset_summary": f"""with {PAIRS}, {SIDE_SUMS},
        n as (
            select (select count(*) from pairs) as pair_rows,
                   (select count(distinct left_id) from pairs) as le, (select count(distinct right_id) from pairs) as re,
                   (select count(*) from positives) as pp, (select count(*) from part) as parts,
                   (select count(*) from supplier) as sups, (select count(*) from embeddings) as embs,
                   (select count(*) from left_on) as lo, (select count(*) from right_on) as ro
        )
        select unnest(['pair_rows', 'left_entities', 'right_entities', 'positive_pairs', 'max_negatives',
            'left_seq_rows', 'left_seq_min_dim', 'left_seq_max_dim', 'left_struct_rows', 'left_struct_min_dim',
            'left_struct_max_dim', 'left_disease_rows', 'left_disease_min_dim', 'left_disease_max_dim',
            'right_seq_rows', 'right_seq_min_dim', 'right_seq_max_dim', 'right_graph_rows', 'right_graph_min_dim',
            'right_graph_max_dim', 'right_ecfp_rows', 'right_ecfp_min_dim', 'right_ecfp_max_dim',
            'right_disease_rows', 'right_disease_min_dim', 'right_disease_max_dim',
            'left_emb_rows', 'left_emb_min_dim', 'left_emb_max_dim']) as item,
            cast(unnest([pair_rows, le, re, pp, le * re - pp, parts, 2, 2, parts, 1, 1, lo, 25, 25, sups, 2, 2, sups, 1, 1,
            sups, 1, 1, ro, 25, 25, embs, (select min(len(embedding)) from embeddings),
            (select max(len(embedding)) from embeddings)]) as bigint) as value
        from n""",
    "negative_capacity": f"""with {PAIRS}
        select (select count(distinct left_id) from pairs) as left_entities,
               (select count(distinct right_id) from pairs) as right_entities,
               (select count(*) from positives) as positive_pairs,
               (select count(distinct left_id) * count(distinct right_id) from pairs)
               - (select count(*) from positives) as max_negatives""",
    "random_pairs": f"""with {PAIRS}, {entities('pairs', 42)}, {draws('(select count(*) from pairs)', 42)}
        select attempt, left_id, right_id from draws""",
    "exclude_pairs": f"""with {PAIRS}, {entities('pairs', 42)}, {draws('(select count(*) from pairs)', 42)}
        select attempt, left_id, right_id from draws d
        where not exists (select 1 from pairs p where p.left_id = d.left_id and p.right_id = d.right_id)""",
    "negative_pairs": f"""with {PAIRS}, {negatives('pairs', 42, '(select count(*) from positives)')}
        select left_id, right_id from negatives""",
    "negative_pairs_ratio2": f"""with {PAIRS}, {negatives('pairs', 42, '(select 2 * count(*) from positives)')}
        select left_id, right_id from negatives""",
    "negative_pairs_repeats": f"""with {PAIRS}, {negatives('pairs', 7, '(select count(*) from pairs)')}
        select left_id, right_id, attempt from negatives""",
    "negative_shortfall": """
        select cast(0 as bigint) as found, count(*) as wanted,
               (select count(distinct user_id) * count(distinct event_type) from events) - count(*) as available
        from (select distinct user_id, event_type from events)""",
    "take_first": """
        select o_orderkey, o_custkey, o_totalprice from orders
        order by o_orderkey limit (select count(*) // 10 from orders)""",
    "take_first_spread": f"""
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, {h60("'42'", 'l_orderkey', 'l_linenumber')} as place
        from lineitem order by place, l_orderkey, l_linenumber, l_partkey, l_suppkey
        limit (select count(*) // 10 from lineitem)""",
    **{
        name: f"""with {PAIRS}
        select left_id, right_id, row_number() over (
            order by {h60("'42'", 'left_id', 'right_id')}, left_id, right_id) as position from positives"""
        for name in ("deterministic_shuffle", "deterministic_shuffle_bucketed")
    },
    "label_union": f"with {LABELLED} select left_id, right_id, label from labelled",
    **{
        name: f"with {SPLIT} select left_id, right_id, label, fold from split"
        for name in ("assign_folds", "assign_folds_bucketed")
    },
    "assign_folds_repeats": f"""with {PAIRS},
        copies as (
            select left_id, right_id, 1 as label, row_number() over (partition by left_id, right_id) as copy_no from pairs
        ),
        split as (
            select left_id, right_id, cast(ntile(5) over (
                order by {h60("'42'", 'left_id', 'right_id', 'label', 'copy_no')}, left_id, right_id, label, copy_no) - 1
                as integer) as fold
            from copies
        )
        select left_id, right_id, fold, count(*) as copies from split group by 1, 2, 3""",
    "fold_summary": f"""with {SPLIT}
        select f.fold,
               (select count(*) from split s where s.fold <> f.fold and label = 1) as train_pos,
               (select count(*) from split s where s.fold <> f.fold and label = 0) as train_neg,
               count(*) filter (where label = 1) as val_pos, count(*) filter (where label = 0) as val_neg
        from split f group by f.fold""",
    "fold_views": f"""with {SPLIT}
        select cast(run as integer) as run, case when fold = run then 'val' else 'train' end as part, label,
               count(*) as n_rows, cast(sum(fold) as bigint) as fold_sum
        from split, range(5) r(run) group by 1, 2, 3""",
    "prepare_splits": f"with {PAIRS}, {SPLIT_SAMPLED} select left_id, right_id, label, fold from split",
    "stored_splits": f"""with {PAIRS}
        select left_id, right_id, label, cast(ntile(5) over (
            order by {h60("'42'", 'left_id', 'right_id', 'label')}, left_id, right_id, label) - 1 as integer) as fold
        from (select distinct left_id, right_id, 1 as label from pairs)""",
    "overlap_check": f"with {STRONG}, {WEAK} select * from strong intersect select * from weak",
    "fold_leak_check": f"""with {STRONG}, {WEAK},
        labelled as (
            select distinct left_id, right_id, 1 as label from strong
            union all select distinct left_id, right_id, 0 from weak
        ),
        split as (
            select left_id, right_id, label, cast(ntile(5) over (
                order by {h60("'42'", 'left_id', 'right_id', 'label')}, left_id, right_id, label) - 1 as integer) as fold
            from labelled
        )
        select fold, count(*) as val_neg,
               count(*) filter (where (left_id, right_id) in (select (left_id, right_id) from strong)) as leaked
        from split where label = 0 group by fold""",
    "pairs_in_several_folds": f"""with {SCORED}
        select left_id, right_id from scored group by 1, 2 having count(distinct fold) > 1""",
    "violation_examples": f"""with {STRONG}, {WEAK}
        select * from (select * from strong intersect select * from weak) order by left_id, right_id limit 5""",
    "assemble_pairs": ASSEMBLED,
    "assemble_pairs_hot": ASSEMBLED,
    "assemble_missing_dropped": f"""with {PAIRS}
        select left_id, right_id, cast(len(embedding) as bigint) as width,
               round(cast(cast(p_size as float) as double) + cast(cast(p_retailprice as float) as double), 3) as left_sum
        from positives
        join embeddings on cast(vec_id as varchar) = left_id
        join part on cast(p_partkey as varchar) = left_id""",
    "assemble_missing_zeros": f"""with {PAIRS}
        select left_id, right_id, cast(coalesce(len(embedding), 64) as bigint) as width,
               round(coalesce(list_sum(cast(embedding as double[])), 0.0), 3) as emb_sum
        from positives left join embeddings on cast(vec_id as varchar) = left_id""",
    "missing_features": f"""with {PAIRS}
        select 'left' as side, 'emb' as modality, left_id as id, count(*) as pairs from pairs
        where left_id not in (select cast(vec_id as varchar) from embeddings) group by left_id
        union all
        select 'right', 'num', right_id, count(*) from pairs
        where right_id not in (select cast(s_suppkey as varchar) from supplier) group by right_id""",
    "onehot_associations": """
        with on_rows as (
            select distinct cast(l_partkey as varchar) as id, s_nationkey from lineitem join supplier on l_suppkey = s_suppkey
        ),
        vocab as (select n_nationkey, row_number() over (order by n_nationkey) - 1 as pos from nation),
        ids as (select distinct id from on_rows)
        select ids.id, pos, cast(o.id is not null as integer) as value
        from ids cross join vocab left join on_rows o on o.id = ids.id and o.s_nationkey = n_nationkey""",
    "onehot_customers": f"""
        with vocab as (
            select c_custkey, row_number() over (order by {h60("'42'", 'c_custkey')}, c_custkey) - 1 as pos from customer
        )
        select distinct cast(l_suppkey as varchar) as id, (select count(*) from customer) as width, pos
        from lineitem join orders on l_orderkey = o_orderkey join vocab on c_custkey = o_custkey""",
    "concat_vectors": f"with {VECTORS} select {KEYS}, a0 as v0, a1 as v1, c0 as v2, c1 as v3 from v",
    "weighted_pool": f"""with {VECTORS}
        select {KEYS}, {r6(pooled(['a0', 'b0', 'c0'], POOL_WEIGHTS), 'p0')},
               {r6(pooled(['a1', 'b1', 'c1'], POOL_WEIGHTS), 'p1')} from v""",
    "fusion_pooled": f"""with {VECTORS}
        select {KEYS}, {r6('a0 * 0.5 + b0 * 0.5', 'f0')}, {r6('a1 * 0.5 + b1 * 0.5', 'f1')}, {r6('c0', 'f2')},
               {r6('c1', 'f3')} from v""",
    "fusion_concat": f"""with {VECTORS}
        select {KEYS}, {', '.join(r6(c, f'f{i}') for i, c in enumerate(('a0', 'a1', 'b0', 'b1', 'c0', 'c1')))} from v""",
    "explode_vector": "select cast(vec_id as varchar) as id, "
    + ", ".join(f"embedding[{i + 1}] as dim_{i}" for i in range(64))
    + " from embeddings",
    "vector_rows": """
        select cast(vec_id as varchar) as id, cast(unnest(range(len(embedding))) as bigint) as pos, unnest(embedding) as value
        from embeddings""",
    "row_normalise": f"""with {VECTORS},
        m as (select *, (a0 + a1 + c0 + c1) / 4 as mu from v),
        s as (select *, sqrt(((a0-mu)*(a0-mu) + (a1-mu)*(a1-mu) + (c0-mu)*(c0-mu) + (c1-mu)*(c1-mu)) / 4) as sd from m)
        select {KEYS}, {', '.join(r6(f'case when sd > 0 then ({c} - mu) / sd else 0 end', f'n{i}')
                                  for i, c in enumerate(('a0', 'a1', 'c0', 'c1')))} from s""",
    **{
        name: f"""with raw as (
            select l_returnflag as side, l_linenumber as modality, avg(l_quantity) as w from lineitem group by 1, 2)
        select side, modality, {r6('exp(w) / sum(exp(w)) over (partition by side)', 'weight')} from raw"""
        for name in ("normalised_weights", "stored_weights")
    },
    "softmax_scores": f"""with z as (select {KEYS}, l_quantity / 10.0 as z0, l_discount * 60.0 as z1 from lineitem)
        select {KEYS}, {r6('exp(z0) / (exp(z0) + exp(z1))', 'p0')}, {r6('exp(z1) / (exp(z0) + exp(z1))', 'p1')},
               {r6('exp(z1) / (exp(z0) + exp(z1))', 'score')} from z""",
    "predict_label": f"""with {SCORED}
        select fold, label, cast(score > 0.5 as integer) as pred, count(*) as n_rows from scored group by 1, 2, 3""",
    "ce_loss": loss_by_fold("-ln(pt)"),
    "ce_loss_clipped": loss_by_fold(
        "-ln(greatest(1e-15::double, least(1 - 1e-15::double, case when label = 1 then score else 1 - score end)))", TIES
    ),
    "ce_loss_logits": f"""
        select l_linenumber - 1 as fold,
               {r6("avg(ln(exp(l_quantity / 10.0) + exp(l_discount * 60.0)) - case when l_returnflag = 'R' then l_discount * 60.0 else l_quantity / 10.0 end)", 'loss')}
        from lineitem group by 1""",
    "focal_loss": loss_by_fold("(case when label = 1 then 0.25 else 0.75 end) * pow(1 - pt, 2.0) * -ln(pt)"),
    "focal_loss_sum": f"""with {SCORED}
        select fold, round(sum((case when label = 1 then 0.6 else 0.4 end) * pow(1 - pt, 1.5) * -ln(pt)), 3) as loss
        from (select *, case when label = 1 then score else 1 - score end as pt from scored) group by fold""",
    "label_smoothing_loss": loss_by_fold("-0.9 * ln(pt) - 0.1 * ln(1 - pt)"),
    "weighted_ce_loss": loss_by_fold(
        "(case when label = 1 then 1.3 else 0.7 end) * -ln(pt)",
        reduce="sum({}) / sum(case when label = 1 then 1.3 else 0.7 end)",
    ),
    "class_weights": f"""with {SCORED},
        c as (
            select fold, 1.0::double / count(*) filter (where label = 0) as i0,
                   1.0::double / count(*) filter (where label = 1) as i1
            from scored group by fold
        )
        select fold, {r6('i0 / (i0 + i1) * 2', 'weight_neg')}, {r6('i1 / (i0 + i1) * 2', 'weight_pos')} from c""",
    "confusion_matrix": f"with {SCORED}, {METRIC_ROWS} select fold, tn, fp, fn, tp from cells",
    "accuracy": f"with {SCORED}, {METRIC_ROWS} select fold, {r6('accuracy', 'accuracy')} from rates",
    "precision_recall_f1": f"""with {SCORED}, {METRIC_ROWS}
        select fold, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')} from rates""",
    "auc_roc": f"with {SCORED}, {METRIC_ROWS} select fold, {r6('auc_roc', 'auc_roc')} from ranked",
    "auc_roc_ties": f"""with {TIES}
        select {r6('''sum(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end)
               / count(*)''', 'auc_roc')}
        from scored a join scored b on a.label = 1 and b.label = 0""",
    "average_precision": f"with {SCORED}, {METRIC_ROWS} select fold, {r6('pr_auc', 'pr_auc')} from ranked",
    "average_precision_ties": f"""with {TIES.replace('cast(doc_id % 3 as integer) as fold', '0 as fold')}, {METRIC_ROWS}
        select {r6('pr_auc', 'pr_auc')} from ranked""",
    "evaluate": f"with {SCORED}, {METRIC_ROWS} {EVALUATED}",
    "evaluate_ranged": f"with {SCORED}, {METRIC_ROWS} {EVALUATED}",
    "evaluate_null_group": f"with {SCORED}, {METRIC_ROWS} select nullif(fold, 0) as fold, * exclude (fold) from ({EVALUATED})",
    "evaluate_ties": f"with {TIES}, {METRIC_ROWS} {EVALUATED}",
    "cv_summary": f"""with {SCORED}, {LONG}
        select metric, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')},
               string_agg(cast(cast(round(value * 1e6) as bigint) as varchar), ',' order by fold) as values_e6
        from long group by metric""",
    "metrics_comparison": f"""with {SCORED}, {LONG}
        select fold, metric, {r6('value', 'value')}, {r6('avg(value) over (partition by metric)', 'mean')} from long""",
    "stored_results": f"""with {SCORED}, {LONG}
        select 'fold_'||fold as item, {r6('auc_roc', 'value')} from evaluated
        union all select metric, {r6('avg(value)', 'value')} from long group by metric""",
    **{
        f"{kind}_points": f"""with {SCORED}, {points(kind)}
        select fold, {r6('threshold', 'threshold')}, {r6('x', 'x')}, {r6('y', 'y')} from points"""
        for kind in ("roc", "pr")
    },
    **{f"{kind}_grid": f"with {SCORED}, {grid(kind)} select fold, i, {r6('y', 'y')} from grid" for kind in ("roc", "pr")},
    **{f"{kind}_grid_ties": f"with {TIES}, {grid(kind)} select fold, i, {r6('y', 'y')} from grid" for kind in ("roc", "pr")},
    **{f"mean_{kind}_curve": f"with {SCORED}, {mean_curve(kind)} {MEAN_OUT}" for kind in ("roc", "pr")},
    "curve_area": f"with {SCORED}, {grid('roc')}, areas as ({area('grid', 'y', 'fold')}) select fold, {r6('area', 'area')} from areas",
    "curve_summary": f"""with {SCORED}, {METRIC_ROWS}, {mean_curve('roc').replace(STEPS + ',', '')},
        roc_area as ({area('mean_grid', 'mean')})
        select 'roc' as kind, {r6('(select area from roc_area)', 'area')}, {r6('stddev_pop(auc_roc)', 'std')} from ranked
        union all select 'pr', {r6('avg(pr_auc)', 'area')}, {r6('stddev_pop(pr_auc)', 'std')} from ranked""",
    "early_stop": f"""with recursive {stop_states(5, '0.001', BETTER_MAX)}
        select run_id, stop_epoch, {r6('best_score', 'best_score')} from stops""",
    "early_stop_long": f"""with recursive {stop_states(5, '0.0005', BETTER_MAX).replace(HISTORY, LONG_HISTORY)}
        select cast(run_id as bigint) as run_id, stop_epoch, {r6('best_score', 'best_score')} from stops""",
    "early_stop_nan": f"""with recursive {stop_states(5, '0.001', "not isnan(h.auc) and " + BETTER_MAX).replace(HISTORY, NAN_HISTORY)}
        select run_id, stop_epoch, {r6('best_score', 'best_score')} from stops""",
    "early_stop_min": f"""with recursive {stop_states(8, '0.01', BETTER_MIN)}
        select run_id, stop_epoch, {r6('best_score', 'best_score')} from stops""",
    "best_epoch": f"""with recursive {stop_states(5, '0.001', BETTER_MAX)},
        ran as (
            select h.*, row_number() over (partition by run_id order by auc desc, epoch) as place
            from history h join stops using (run_id)
            where auc > 0 and (stop_epoch is null or epoch <= stop_epoch)
        )
        select run_id, cast(epoch as integer) as epoch, {r6('auc', 'auc')} from ran where place = 1""",
    "score_linear": f"""
        select {KEYS}, {r6('1 / (1 + exp(-(0.04 * l_quantity + -0.00002 * l_extendedprice + 3.0 * l_discount - 0.6)))', 'score')}
        from lineitem""",
    "project_modality": f"""
        with n as (
            select cast(s_suppkey as varchar) as id, cast(cast(s_acctbal as float) as double) as a,
                   cast(s_nationkey as double) as b
            from supplier
        )
        select id, {r6('(a - avg(a) over ()) / stddev_samp(a) over ()', 'd0')},
               {r6('(b - avg(b) over ()) / stddev_samp(b) over ()', 'd1')},
               cast(0 as double) as d2, cast(0 as double) as d3
        from n""",
    "predictions_simple": f"""with {SCORED}
        select label as true_label, {r6('score', 'predicted_score')}, fold from scored""",
    **{
        name: f"""with {SCORED}
        select left_id, right_id, label as true_label, {r6('score', 'predicted_score')}, fold from scored"""
        for name in ("predictions_detail", "all_folds_predictions")
    },
    "fused_features_concat": f"""with {SPLIT}
        select left_id, {r6('cast(cast(p_size as float) as double)', 'dim_0')},
               {r6('cast(cast(p_retailprice as float) as double)', 'dim_1')},
               {r6('cast(cast(p_retailprice as float) as double)', 'dim_2')}, cast(fold as bigint) as fold
        from split join part on cast(p_partkey as varchar) = left_id""",
    "raw_features_export": f"""with {SPLIT}
        select right_id, label, {r6('cast(cast(s_acctbal as float) as double)', 'right_seq_dim_0')},
               {r6('cast(s_nationkey as double)', 'right_seq_dim_1')}, {r6('cast(cast(s_acctbal as float) as double)', 'right_graph_dim_0')},
               {r6('cast(s_nationkey as double)', 'right_ecfp_dim_0')}, cast(fold as bigint) as fold
        from split join supplier on cast(s_suppkey as varchar) = right_id""",
    "cross_validate": f"""with {PAIRS}, {SPLIT_SAMPLED}, {fold_numbers(5)}, {logistic('l0', 'r0')}, {METRIC_ROWS} {EVALUATED}""",
    "cross_validate_summary": f"""with {SPLIT}, {fold_numbers(5)}, {logistic('l0', 'r0', weight='case when label = 1 then 3.0 else 1.0 end')}, {LONG}
        select metric, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')} from long group by metric""",
    "cross_validate_predictions": f"""with {PAIRS}, {SPLIT_SAMPLED.replace('ntile(5)', 'ntile(2)')}, {fold_numbers(2)}, {logistic('l0', 'r0')}
        select left_id, right_id, label, fold, round(score, 5) as score, cast(score > 0.5 as integer) as pred from scored""",
    "cross_validate_separable": f"""with {BRANDED}
        select fold, {', '.join(f'cast(1 as double) as {m}' for m in ('accuracy', 'auc_roc', 'pr_auc', 'f1', 'precision', 'recall'))},
               count(*) filter (where label = 0) as tn, cast(0 as bigint) as fp, cast(0 as bigint) as fn, count(*) filter (where label = 1) as tp
        from split group by fold""",
    "cross_validate_constant": f"""with {SPLIT},
        scored as (
            select s.left_id, s.right_id, s.label, s.fold, share as score from split s
            join (select run, avg(label) as share from split, (select unnest(range(5)) as run) where fold <> run group by run) on run = s.fold
        ), {METRIC_ROWS} {EVALUATED}""",
    "score_separable": f"""with {BRANDED}
        select left_id, right_id, label, label as pred, label as sure from labelled""",
    "ablation": " union all ".join(
        f"""select * from (with {SPLIT.replace('ntile(5)', 'ntile(2)')}, {fold_numbers(2)}, {logistic(a, b)}, {METRIC_ROWS}
        select '{name}' as modalities, fold, {', '.join(r6(c, c) for c in ('accuracy', 'auc_roc', 'pr_auc', 'f1', 'precision', 'recall', 'loss'))}
        from evaluated)"""
        for name, a, b in (("left_seq+right_seq", "l0", "r0"), ("left_struct+right_struct", "l1", "r1"))
    ),
    "modality_features": f"""with {SPLIT}, {fold_numbers(5)}
        select left_id, right_id, fold, round(l0, 5) as left_seq, round(l1, 5) as left_struct, round(r0, 5) as right_seq,
               round(r1, 5) as right_graph
        from z where run = fold""",
    "modality_features_reduced": f"""with {SPLIT}, {fold_numbers(5)},
        signs as (
            select run, sign(corr(price, size)) as s from (select distinct run, left_id from split join runs on fold <> run)
            join left_raw using (left_id) group by run
        )
        select left_id, right_id, fold, round(abs(l0 + s * l1) / sqrt(2), 5) as component from z join signs using (run) where run = fold""",
    "fused_features": f"""with {SPLIT}, {fold_numbers(5)}
        select left_id, right_id, label, fold, round((l0 + l1) / 2, 5) as left_fused, round((r0 + r1) / 2, 5) as right_fused
        from z where run = fold""",
    "projection_2d": f"""with {SPLIT}, {fold_numbers(5)},
        seen as (
            select 'sequence' as view, fold, left_id, right_id, label, l0 as l, r0 as r from z where run = fold
            union all select 'structure', fold, left_id, right_id, label, l1, r1 from z where run = fold
            union all select 'fused', fold, left_id, right_id, label, (l0 + l1) / 2, (r0 + r1) / 2 from z where run = fold
        ),
        spread as (
            select view, fold, var_samp(l) as a, var_samp(r) as b, covar_samp(l, r) as c from seen group by view, fold
        ),
        top as (select *, (a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + c * c) as high from spread),
        raw as (select view, fold, case when a >= b then high - b else c end as u, case when a >= b then c else high - a end as v from top),
        axes as (
            select view, fold, u / sqrt(u * u + v * v) * case when abs(u) >= abs(v) then sign(u) else sign(v) end as u,
                   v / sqrt(u * u + v * v) * case when abs(u) >= abs(v) then sign(u) else sign(v) end as v
            from raw
        ),
        -- the second axis is (v, -u) with its larger loading positive
        turned as (select *, case when abs(v) >= abs(u) then sign(v) else -sign(u) end as t from axes)
        select view, fold, left_id, right_id, round(l * u + r * v, 4) as x, round(t * (l * v - r * u), 4) as y, label
        from seen join turned using (view, fold)""",
    "run_record": """
        select n.name, 'miRNA-drug' as dataset, 'left_seq+right_seq' as modalities, cast(7 as integer) as n_folds,
               cast(42 as integer) as seed, true as versions, n_rows
        from (
            select 'part' as name, count(*) as n_rows from part union all select 'supplier', count(*) from supplier
            union all select 'lineitem', count(*) from lineitem
        ) n""",
}

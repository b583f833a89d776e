"""DuckDB SQL for the registered queries: dense sums, closed forms and recursive descriptions of trees."""

from __future__ import annotations

SUP = "p as (select s_suppkey as dof, s_acctbal as x from supplier)"
CUS = "p as (select c_custkey as dof, c_acctbal as x from customer)"
BASE = "l as (select 0.1 * (max(x) - min(x)) as l, avg(x) as m from p), b as (select dof, x, exp(-abs(x - m) / l) as v from p, l)"
E = "exp(-abs(i.x - j.x) / l)"


def _dense(kernel: str = E, points: str = SUP, digits: int = 6, outer: str = "{s}", weight: str = "j.v") -> str:
    s = f"sum({kernel} * {weight})"
    return f"with {points}, {BASE} select i.dof, round({outer.format(s=s)}, {digits}) + 0.0 as y from b i, b j, l group by i.dof, i.v"


def _tree(divider: int, leaf: int, points: str = SUP) -> str:
    """Nodes of the median tree, which on a line depends on the number of points alone."""
    return f"""with recursive {points}, k as (select unnest(range(0, {divider})) as k), t(path, off, n) as (
      select 'r', cast(0 as bigint), (select count(*) from p)
      union all select path || k, off + n * k // {divider}, n * (k + 1) // {divider} - n * k // {divider} from t, k where n > {leaf})
    """


def _blocks_standard() -> str:
    low = """(least(xs[ro + rn] - xs[ro + 1], xs[co + cn] - xs[co + 1]) > 0
      and least(xs[ro + rn] - xs[ro + 1], xs[co + cn] - xs[co + 1]) <= 2 * greatest(0, xs[ro + 1] - xs[co + cn], xs[co + 1] - xs[ro + rn]))"""
    kid = "case when rn > 12 then rn * (i + 1) // 2 - rn * i // 2 else rn end"
    kjd = "case when cn > 12 then cn * (j + 1) // 2 - cn * j // 2 else cn end"
    return f"""with recursive {SUP}, s as (select array_agg(x order by x, dof) as xs, count(*) as n from p),
    t(ro, rn, co, cn) as (
      select cast(0 as bigint), n, cast(0 as bigint), n from s
      union all
      select ro + case when rn > 12 then rn * i // 2 else 0 end, {kid}, co + case when cn > 12 then cn * j // 2 else 0 end, {kjd}
      from t, s, (values (0), (1)) as a(i), (values (0), (1)) as c(j)
      where not {low} and (rn > 12 or cn > 12) and (i = 0 or rn > 12) and (j = 0 or cn > 12) and rn >= 2 and cn >= 2)
    select ro as r_off, rn as r_n, co as c_off, cn as c_n, case when {low} and rn > 1 and cn > 1 then 'rk' else 'full' end as kind
    from t, s where {low} or (rn <= 12 and cn <= 12) or rn < 2 or cn < 2"""


def _blocks_hodlr(which: str = "true", leaf: int = 12) -> str:
    tree = _tree(2, leaf)
    return tree + f"""select a.off as r_off, a.n as r_n, c.off as c_off, c.n as c_n, case when a.path = c.path then 'full' else 'rk' end as kind
    from t a, t c where ((a.path = c.path and a.n <= {leaf}) or (a.path <> c.path and left(a.path, -1) = left(c.path, -1))) and ({which})"""


RHS = f"with {SUP}, {BASE} select dof, round(v, 6) + 0.0 as y from b"
LINE = f"with {SUP}, {BASE}, o as (select dof, x, v, exp(-(x - lag(x) over (order by x, dof)) / l) as q, exp(-(lead(x) over (order by x, dof) - x) / l) as r, lag(v) over (order by x, dof) as w, row_number() over (order by x, dof) as k from b, l)"
LOGDET = LINE + " select round(sum(ln(1 - q * q)), 5) + 0.0 as logdet from o"


def _info() -> str:
    return f"""with h as ({_blocks_hodlr()}) select cast(count(*) filter (kind = 'rk') as bigint) as rk_count, cast(count(*) filter (kind = 'full') as bigint) as full_count,
    cast(sum(r_n * c_n) filter (kind = 'rk') as bigint) as rk_size, cast(sum(r_n * c_n) filter (kind = 'full') as bigint) as full_size, cast(sum(r_n * c_n) as bigint) as uncompressed_size,
    cast(sum(case when kind = 'rk' then r_n + c_n else r_n * c_n end) as bigint) as compressed_size, 1 as largest_rank from h"""


def oracle_sql() -> dict[str, str]:
    gemv = _dense()
    sorted_values = f"with {SUP}, {BASE}, o as (select x, row_number() over (order by x, dof) - 1 as k from p)"
    cus_tree = _tree(2, 100, CUS)
    rank = f"with h as ({_blocks_hodlr()}) select 1 as rank, count(*) as blocks from h where kind = 'rk'"
    out = {
        "cluster_median_nodes": _tree(2, 12) + " select path, off, n, n <= 12 as is_leaf from t",
        "cluster_median_k3": _tree(3, 12) + " select path, off, n, n <= 12 as is_leaf from t",
        "cluster_median_distributed": cus_tree + " select path, off, n, n <= 100 as is_leaf from t",
        "cluster_perm": f"with {SUP} select row_number() over (order by x, dof) - 1 as pos, dof from p",
        "cluster_geometric": f"with {SUP}, a as (select x, x >= (select (min(x) + max(x)) / 2 from p) as d from p), m as (select d, (min(x) + max(x)) / 2 as m from a group by d), c as (select cast(a.d as int) || cast(cast(x >= m as int) as varchar) as k, count(*) as n from a join m on a.d = m.d group by 1) select 'r' || k as path, cast(coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as off, n from c",
        "cluster_octree": "with p as (select p_retailprice as x, cast(p_size as double) as y from part), b as (select (min(x) + max(x)) / 2 as mx, (min(y) + max(y)) / 2 as my, greatest(max(x) - min(x), max(y) - min(y)) / 4 as q from p), a as (select x >= mx as dx, y >= my as dy, x >= mx + (case when x >= mx then q else -q end) as ex, y >= my + (case when y >= my then q else -q end) as ey from p, b), c as (select 1000 * cast(dx as int) + 2000 * cast(dy as int) + cast(ex as int) + 2 * cast(ey as int) as k, count(*) as n from a group by 1) select cast(coalesce(sum(n) over (order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as off, n from c",
        "cluster_hybrid": f"with {SUP}, o as (select x, row_number() over (order by x, dof) - 1 as k, count(*) over () as n from p), h as (select greatest(max(x) filter (k < n // 2) - min(x), max(x) - min(x) filter (k >= n // 2)) > 0.8 * (max(x) - min(x)) as geo, (min(x) + max(x)) / 2 as mid, any_value(n) as n from o), c as (select case when geo then (select count(*) from o where x < mid) else n // 2 end as a, n from h) select 'r0' as path, 0 as off, a as n from c union all select 'r1', a, n - a from c",
        "cluster_void": f"with recursive {SUP}, k as (select unnest([0, 1]) as k), t(path, off, n, depth) as (select 'r', cast(0 as bigint), (select count(*) from p), 0 union all select path || k, case when depth % 2 = 1 then off + k * n else off + n * k // 2 end, case when depth % 2 = 1 then n * (1 - k) else n * (k + 1) // 2 - n * k // 2 end, depth + 1 from t, k where n > 12) select path, off, n from t",
        "cluster_shuffle": f"with recursive {CUS}, k as (select unnest(range(0, 4)) as k), t(path, off, n, depth) as (select 'r', cast(0 as bigint), (select count(*) from p), 0 union all select path || k, off + n * k // (2 + depth % 3), n * (k + 1) // (2 + depth % 3) - n * k // (2 + depth % 3), depth + 1 from t, k where n > 100 and k < 2 + depth % 3) select path, off, n from t",
        "cluster_ntiles": f"with {SUP}, n as (select count(*) as n from p), k as (select unnest(range(0, (n + 15) // 16)) as k, n from n) select 16 * k as off, least(16, n - 16 * k) as n from k",
        "gemv_embeddings": "with p as (select vec_id as dof, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings), u as (select unnest(range(1, 65)) as k), f as (select dof, k, x[k] as v from p, u), c as (select k, avg(v) as m, max(v) - min(v) as e from f group by 1), l as (select 0.1 * max(e) as l from c), b as (select dof, exp(-sqrt(sum((v - m) ** 2)) / any_value(l)) as w from f join c using (k), l group by 1), z as (select k, sum(v * w) as z from f join b using (dof) group by 1) select dof, round(sum(v * z), 5) + 0.0 as y from f join z using (k) group by 1",
        "cluster_span": "with p as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by o_custkey), e as (select 0.8 * (max(hi) - min(lo)) as e from p), c as (select count(*) filter (hi - lo > e) as w, count(*) as n from p, e), h as (select case when w = n then 0 else w end as w, n from c) select 'r0' as path, 0 as off, (n - w) // 2 as n from h union all select 'r1', (n - w) // 2, n - w - (n - w) // 2 from h union all select 'r2', n - w, w from h where w > 0",
        "cluster_grouped": "select s_nationkey, cast(1 as bigint) as leaves from supplier group by 1",
        "cluster_boxes": "select min(p_retailprice) as x0, max(p_retailprice) as x1, cast(min(p_size) as double) as y0, cast(max(p_size) as double) as y1, count(*) as n from part",
        "perm_roundtrip": f"with {SUP}, {BASE} select dof, round(v, 9) + 0.0 as y from b",
        "blocks_hodlr": _blocks_hodlr(),
        "blocks_standard": _blocks_standard(),
        "blocks_lower_symmetric": _blocks_hodlr("a.off >= c.off"),
        "blocks_always": f"with recursive {SUP}, t(ro, rn, co, cn) as (select cast(0 as bigint), (select count(*) from p), cast(0 as bigint), (select count(*) from p) union all select ro + rn * i // 2, rn * (i + 1) // 2 - rn * i // 2, co + cn * j // 2, cn * (j + 1) // 2 - cn * j // 2 from t, (values (0), (1)) as a(i), (values (0), (1)) as c(j) where rn * cn > 1000 and rn > 12 and cn > 12) select ro as r_off, rn as r_n, co as c_off, cn as c_n, 'rk' as kind from t where rn * cn <= 1000",
        "blocks_never": f"with {SUP} select cast(count(*) * count(*) as bigint) as cells, true as small, cast(0 as bigint) as rk from p",
        "matrix_info": _info(),
        "matrix_profile": f"with h as ({_blocks_hodlr()}) select kind, count(*) as blocks from h group by 1",
        "json_dump": _tree(2, 12) + ", h as (select case when a.path = c.path then case when a.n <= 12 then 'full' else 'node' end else 'rk' end as kind from t a, t c where a.path = c.path or (left(a.path, -1) = left(c.path, -1))) select kind, count(*) as n from h group by 1",
        "text_points": "select row_number() over (order by s_suppkey) - 1 as dof, s_acctbal as x from supplier",
        "array_file": f"with {SUP}, {BASE}, o as (select v, row_number() over (order by x, dof) - 1 as k from b) select k as row, cast(0 as bigint) as col, round(v, 9) + 0.0 as y from o union all select k, 1, round(v * (k % 7), 9) + 0.0 from o",
        "gemv_null_hints": _dense("case when i.x < 0 or j.x < 0 then 0 else exp(-abs(i.x - j.x) / l) end"),
        "tree_walk": _tree(2, 12) + " select a.path, count(*) filter (b.off + b.n <= a.off or (b.path <> a.path and starts_with(a.path, b.path))) as pre, count(*) filter (b.off + b.n <= a.off or (b.path <> a.path and starts_with(b.path, a.path))) as post from t a, t b group by 1",
        "tree_slice": f"with {SUP}, o as (select dof, row_number() over (order by x, dof) - 1 as pos, count(*) over () as n from p) select pos, dof from o where pos >= n // 2 and pos < n // 2 + (n - n // 2) // 2",
        "moved_dof": f"with {SUP} select count(*) as n, count(distinct dof) as dofs, cast(0 as bigint) as wrong_places, cast(0 as bigint) as out_of_leaf, cast(0 as bigint) as torn_nodes, count(*) // 2 - 1 as left_n from p",
        "json_points": f"with {SUP} select row_number() over (order by x, dof) - 1 as pos, dof, x as coord from p",
        "gemv_n": gemv,
        "gemv_t": _dense(outer="i.v * {s}"),
        "gemv_symmetric": gemv,
        "gemv_alpha_beta": _dense(outer="2 * {s} - i.v"),
        "gemv_multi_rhs": f"with {SUP}, {BASE} select i.dof, 0 as rhs, round(sum({E} * j.v), 6) + 0.0 as y from b i, b j, l group by 1 union all select i.dof, 1, round(sum({E} * j.v * (1 + j.dof % 7)), 6) + 0.0 from b i, b j, l group by 1",
        "gemm_dense_right": _dense(outer="i.v * {s}"),
        "gemv_complex": f"with {SUP}, {BASE} select i.dof, round(sum(cos((abs(i.x - j.x) + 1e-10) / l) / (4 * pi() * (abs(i.x - j.x) + 1e-10)) * j.v) * 1000, 1) + 0.0 as re from b i, b j, l where i.dof <> j.dof group by 1",
        "gemv_strata": _dense(f"({E} + 0.5 * exp(-abs(i.x - j.x) / (2 * l)))"),
        "gemv_customers": _dense(points=CUS, digits=4),
        "gemv_parts": "with p as (select p_partkey as dof, p_retailprice as x, cast(p_size as double) as y from part), l as (select 0.1 * greatest(max(x) - min(x), max(y) - min(y)) as l, avg(x) as mx, avg(y) as my from p), b as (select dof, x, y, exp(-sqrt((x - mx) ** 2 + (y - my) ** 2) / l) as v from p, l) select i.dof, round(sum(exp(-sqrt((i.x - j.x) ** 2 + (i.y - j.y) ** 2) / l) * j.v), 4) + 0.0 as y from b i, b j, l group by 1",
        "norm_fro": f"with {SUP}, {BASE} select round(sqrt(sum({E} * {E})), 6) + 0.0 as norm from b i, b j, l",
        "diagonal": f"with {SUP} select dof, 1.5 as y from p",
        "eval_dense": f"with {SUP}, {BASE} select i.dof as row_dof, j.dof as col_dof, round({E}, 6) + 0.0 as v from b i, b j, l",
        "get_values": f"with {SUP}, {BASE} select i.dof as row_dof, j.dof as col_dof, round({E}, 6) + 0.0 as v from b i, b j, l where j.dof in (select n_nationkey from nation)",
        "get_block": sorted_values + f" select i.k as row_pos, j.k as col_pos, round({E}, 6) + 0.0 as v from o i, o j, l where i.k between 3 and 6 and j.k between 1 and 6",
        "scale": _dense(outer="-2.5 * {s}"),
        "axpy": _dense(f"(4 * {E} + 1.5 * exp(-abs(i.x - j.x) / (2 * l)))"),
        "add_identity": _dense(outer="{s} + 0.75 * i.v"),
        "transpose": _dense(outer="i.v * {s}"),
        "truncate": _dense(f"({E} + 0.5 * exp(-abs(i.x - j.x) / (2 * l)))"),
        "coarsen": gemv,
        "copy_struct": f"with {SUP} select dof, 0.0 as y from p",
        "gemm_hh": f"with {SUP}, {BASE}, y as (select i.dof, i.x, sum({E} * j.v) as v from b i, b j, l group by 1, 2) select i.dof, round(sum({E} * j.v), 5) + 0.0 as y from y i, y j, l group by 1",
        "gemm_into": f"with {SUP}, {BASE}, y as (select i.dof, i.x, sum({E} * j.v) as v from b i, b j, l group by 1, 2) select i.dof, round(2 * sum({E} * j.v) - any_value(i.v), 5) + 0.0 as y from y i, y j, l group by 1",
        "diagonal_blocks": f"with {SUP}, {BASE}, o as (select x, row_number() over (order by x, dof) - 1 as k from p) select i.k // 7 as block, cast(i.k % 7 as int) as i, cast(j.k % 7 as int) as j, round({E}, 6) + 0.0 as v from o i, o j, l where i.k // 7 = j.k // 7",
        "child_gemv": f"with {SUP}, {BASE}, o as (select dof, x, v, row_number() over (order by x, dof) - 1 as k, count(*) over () as n from b) select i.dof, round(sum({E} * j.v), 6) + 0.0 as y from o i, o j, l where i.k < i.n // 2 and j.k < j.n // 2 group by 1",
        "multiply_diagonal": _dense(weight="j.v * j.v"),
        "subtract_mdmt": f"with {SUP}, {BASE}, y as (select i.dof, i.x, i.v as b, sum({E} * j.v) as v from b i, b j, l group by 1, 2, 3) select i.dof, round(any_value(i.v) - sum({E} * j.b * j.v), 4) + 0.0 as y from y i, y j, l group by 1",
        "matrix_checks": f"with h as ({_blocks_hodlr()}) select cast(sum(case when kind = 'rk' then r_n + c_n else r_n * c_n end) as bigint) as stored, cast(0 as bigint) as not_finite, false as all_zero from h",
        "compression_errors": f"with h as ({_blocks_standard()}) select count(*) as blocks, cast(0 as bigint) as beyond from h where kind = 'rk'",
        "axpy_other_tree": _dense(outer="4 * {s}"),
        "gemv_conjugate": f"with {SUP}, {BASE} select i.dof, round(-sum(sin((abs(i.x - j.x) + 1e-10) / l) / (4 * pi() * (abs(i.x - j.x) + 1e-10)) * j.v) * 1000, 1) + 0.0 as im from b i, b j, l where i.dof <> j.dof group by 1",
        "hodlrsym_solve": RHS,
        "hodlrsym_times": gemv,
        "llt_times": gemv,
        "factor_reuse": f"with {SUP}, {BASE} select dof, k as rhs, round((k + 1) * v, 6) + 0.0 as y from b, (values (0), (1)) as r(k)",
        "solve_transposed": RHS,
        "trsm_llt": RHS,
        "trsm_lu_right": RHS,
        "logdet_hodlrsym": LOGDET,
        "inverse_gemv": RHS.replace(", 6)", ", 5)"),
        "lu_solve": RHS,
        "llt_solve": RHS,
        "ldlt_solve": RHS,
        "hodlr_solve": RHS,
        "solve_customers_nugget": RHS.replace(SUP, CUS),
        "chol_lower_1d": LINE + " select dof, round(case when k = 1 then v else (v - q * w) / sqrt(1 - q * q) end, 5) + 0.0 as y from o",
        "logdet_lu": LOGDET,
        "logdet_llt": LOGDET,
        "logdet_ldlt": LOGDET,
        "logdet_hodlr": LOGDET,
        "inverse_diagonal": LINE + " select dof, round(1 + coalesce(q * q / (1 - q * q), 0) + coalesce(r * r / (1 - r * r), 0), 3) + 0.0 as y from o",
        "rank_gram_embeddings": "select 64 as rank",
        "quantised_gemv": _dense(digits=4),
        "io_roundtrip": gemv,
        "power_iteration": f"with recursive {SUP}, l as (select 0.1 * (max(x) - min(x)) as l from p), k as (select i.dof as i, j.dof as j, {E} as v from p i, p j, l), t(step, i, x) as (select 0, dof, cast(1 as double) from p union all select step + 1, k.i, sum(k.v * t.x) / max(n) from (select step, i, x, sqrt(sum(x * x) over ()) as n from t) t join k on k.j = t.i where step < 25 group by step, k.i) select round(sqrt(sum(x * x)), 5) as value from t where step = 25",
        "cylinder_points": "with s as (select 1.75 * pi() / sqrt(500) as step), t as (select step, floor(2 * pi() / step) as turn from s), p as (select unnest(range(0, 500)) as dof) select dof, round(cos(dof * (2 * pi() / turn)), 6) + 0.0 as x, round(sin(dof * (2 * pi() / turn)), 6) + 0.0 as y, round(dof * (step / turn), 6) + 0.0 as z from p, t",
    }
    two = f"with h as ({_blocks_hodlr(leaf=30)}) select 2 as rank, count(*) as blocks from h where kind = 'rk'"
    out["gemv_parts_stored"] = out["gemv_parts"]
    out["gemv_ratio"] = out["gemv_n"]
    out["blocks_width"] = "select cast(count(*) * count(*) as bigint) as cells, true as narrow from supplier"
    out["perturbed_rows"] = "select s_suppkey as row_dof, (select count(*) from supplier) as cells, (select count(*) from supplier) as inside, true as changed from supplier"
    methods = ("svd", "aca_full", "aca_partial", "aca_plus", "aca_random", "rrqr")
    return out | {f"rank_{m}": rank for m in methods} | {f"rank_two_{m}": two for m in methods}

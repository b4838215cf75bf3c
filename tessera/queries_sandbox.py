"""Queries of the SQL sandbox: each is one SELECT over the view `sheet`."""

from __future__ import annotations

from tessera.catalog import query, table
from tessera.plans import sandbox

STATEMENTS = {
    "sandbox_filter": ("lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM sheet WHERE l_quantity > 45 AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'"),
    "sandbox_groupby": (
        "lineitem",
        """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc,
        min(l_tax) AS min_tax, max(l_tax) AS max_tax, count(*) AS n FROM sheet WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    ),
    "sandbox_having": ("orders", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM sheet GROUP BY o_custkey HAVING count(*) >= 15"),
    "sandbox_distinct": ("part", "SELECT DISTINCT p_brand, p_type FROM sheet"),
    "sandbox_count_distinct": ("lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber) AS numbers FROM sheet GROUP BY l_returnflag"),
    "sandbox_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2, count(*) AS n FROM sheet GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "sandbox_rollup": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM sheet GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    "sandbox_grouping_sets": ("customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM sheet GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())"),
    "sandbox_window": (
        "orders",
        """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr,
        lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after2, ntile(4) OVER w AS quarter FROM sheet WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    ),
    "sandbox_window_frames": (
        "orders",
        """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
        min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near,
        first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_key, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM sheet""",
    ),
    "sandbox_selfjoin": ("nation", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM sheet a JOIN sheet b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "sandbox_left_join": ("orders", "SELECT a.o_orderkey, b.n FROM sheet a LEFT JOIN (SELECT o_custkey, count(*) AS n FROM sheet GROUP BY o_custkey HAVING count(*) > 12) b ON a.o_custkey = b.o_custkey"),
    "sandbox_full_join": (
        "part",
        "SELECT a.k AS a_k, b.k AS b_k, a.n AS a_n, b.n AS b_n FROM (SELECT p_size AS k, count(*) AS n FROM sheet WHERE p_size <= 30 GROUP BY p_size) a FULL JOIN (SELECT p_size AS k, count(*) AS n FROM sheet WHERE p_size >= 20 GROUP BY p_size) b ON a.k = b.k",
    ),
    "sandbox_right_join": ("supplier", "SELECT b.s_suppkey, a.top FROM (SELECT s_nationkey, max(s_acctbal) AS top FROM sheet WHERE s_acctbal > 5000 GROUP BY s_nationkey) a RIGHT JOIN sheet b ON a.s_nationkey = b.s_nationkey"),
    "sandbox_union": ("customer", "SELECT c_custkey AS k, 'rich' AS kind FROM sheet WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 'poor' FROM sheet WHERE c_acctbal < 0 UNION SELECT c_custkey, 'first' FROM sheet WHERE c_custkey <= 10"),
    "sandbox_intersect": ("lineitem", "SELECT l_orderkey FROM sheet WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM sheet WHERE l_quantity > 40"),
    "sandbox_except": ("orders", "SELECT o_custkey FROM sheet EXCEPT SELECT o_custkey FROM sheet WHERE o_orderstatus = 'F'"),
    "sandbox_subquery": ("part", "SELECT p_partkey, p_retailprice FROM sheet p WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM sheet) AND p_brand IN (SELECT p_brand FROM sheet GROUP BY p_brand HAVING count(*) > 10)"),
    "sandbox_correlated": ("customer", "SELECT c_custkey FROM sheet a WHERE c_acctbal = (SELECT max(b.c_acctbal) FROM sheet b WHERE b.c_nationkey = a.c_nationkey)"),
    "sandbox_exists": ("orders", "SELECT o_orderkey FROM sheet a WHERE EXISTS (SELECT 1 FROM sheet b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM sheet b WHERE b.o_custkey = a.o_custkey AND b.o_orderpriority = '5-LOW')"),
    "sandbox_topk": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM sheet ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"),
    "sandbox_offset": ("orders", "SELECT o_orderkey, o_totalprice FROM sheet ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40"),
    "sandbox_group_topk": ("orders", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM sheet) t WHERE r <= 2"),
    "sandbox_case": ("part", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, sum(CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END) AS dear FROM sheet GROUP BY 1"),
    "sandbox_string_functions": (
        "customer",
        """SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, substr(c_name, 1, 8) AS head, replace(c_name, '#', '-') AS dashed, concat(c_mktsegment, '/', c_name) AS both,
        trim('  x ') AS trimmed, reverse(c_mktsegment) AS back, lpad(c_mktsegment, 12, '*') AS padded, left(c_name, 3) AS l3, right(c_name, 4) AS r4, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS kind FROM sheet""",
    ),
    "sandbox_math_functions": (
        "part",
        "SELECT p_partkey, abs(-p_size) AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(sqrt(p_size), 6) AS s, round(ln(p_retailprice), 6) AS l, p_size % 7 AS m, round(power(p_size, 2), 2) AS p2, greatest(p_size, 20) AS g, least(p_size, 20) AS least_, sign(p_size - 25) AS sg FROM sheet",
    ),
    "sandbox_date_functions": (
        "orders",
        "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, min(day(o_orderdate)) AS d, max(quarter(o_orderdate)) AS q FROM sheet WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY year(o_orderdate), month(o_orderdate)",
    ),
    "sandbox_cast": ("part", "SELECT p_partkey, CAST(p_size AS VARCHAR(10)) AS s, CAST(floor(p_retailprice) AS BIGINT) AS i, CAST('12' AS INT) + p_size AS n, p_size IS NULL AS missing, p_brand = 'Brand#11' OR p_size > 40 AS picked FROM sheet"),
    "sandbox_percentile": ("lineitem", "SELECT l_returnflag, median(l_quantity) AS med, round(stddev_samp(l_quantity), 5) AS sd, round(var_pop(l_discount), 8) AS v, round(corr(l_quantity, l_extendedprice), 6) AS r FROM sheet GROUP BY l_returnflag"),
    "sandbox_conditional_aggregate": ("lineitem", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS many, round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 2) AS returned, bool_or(l_tax > 0.07) AS any_tax, bool_and(l_quantity > 0) AS all_qty FROM sheet GROUP BY l_linestatus"),
    "sandbox_derived": ("lineitem", "SELECT m, count(*) AS orders_, round(avg(total), 2) AS mean FROM (SELECT l_orderkey, count(*) AS m, sum(l_extendedprice) AS total FROM sheet GROUP BY l_orderkey) t GROUP BY m"),
}


def _register(name: str, of: str, sql: str) -> None:
    query(name, f"WITH sheet AS (SELECT * FROM {of}) {sql}")(lambda spark, sf: sandbox.select(table(spark, sf, of), sql))


for _name, (_table, _sql) in STATEMENTS.items():
    _register(_name, _table, _sql)


@query("sandbox_truncation", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, (SELECT count(*) FROM lineitem WHERE l_quantity = 50) AS raw_rows, true AS truncated FROM lineitem WHERE l_quantity = 50 ORDER BY lineitem.l_orderkey, lineitem.l_linenumber LIMIT 100")
def sandbox_truncation(spark, sf):
    """The rendered result: strings, 100 rows at most, and how many there were."""
    return sandbox.rendered(sandbox.select(table(spark, sf, "lineitem"), "SELECT l_orderkey, l_linenumber FROM sheet WHERE l_quantity = 50 ORDER BY l_orderkey, l_linenumber"))


#: Statements and whether the guard lets them through.
GUARDED = (
    ("  SELECT 1  ", True), ("", False), ("INSERT INTO sheet VALUES (1)", False), ("DROP TABLE sheet", False), ("SELECT * FROM sheet; DELETE FROM sheet", False),
    ("WITH x AS (SELECT 1) SELECT * FROM x", False), ("select 'drop'", False), ("select 'please call; or set' as x from sheet", True), ("SELECT * FROM sheet;", True), ("SELECT 'vacuum' FROM sheet", False),
    ("SELECT count(*) FROM parquet.`/tmp/x.parquet`", False), ("SELECT java_method('java.lang.System', 'getProperty', 'user.name')", False), ("SELECT reflect('java.lang.System', 'exit', 0)", False),
    ("SELECT try_reflect('java.lang.Math', 'abs', -1)", False), ("SELECT * FROM nation", False), ("SELECT * FROM sheet, nation", False), ("SELECT * FROM sheet s JOIN other o ON s.a = o.a", False),
    ("SELECT * FROM sheet s JOIN sheet t ON s.a = t.a, sheet u", True), ("SELECT * FROM range(10)", False), ("SELECT * FROM explode(array(1, 2))", False), ("SELECT * FROM (SELECT a FROM sheet) t", True),
    ("SELECT * FROM (TABLE nation) t", False), ("SELECT a FROM sheet WHERE EXISTS (SELECT 1 FROM nation)", False), ("SELECT a FROM sheet WHERE a IN (SELECT b FROM sheet)", True), ("SELECT a FROM default.sheet", False),
    ("SELECT extract(YEAR FROM d), trim(BOTH 'x' FROM e) FROM sheet", True), ("SELECT a IS DISTINCT FROM b FROM sheet", True), ("SELECT input_file_name() FROM sheet", False), ("SELECT my_udf(a) FROM sheet", False),
    ("SELECT `reflect`('a', 'b')", False), ("SELECT main.f(a) FROM sheet", False), ("SELECT transform(a) USING 'cat' FROM sheet", False), ("SELECT * FROM (MAP a USING 'cat' FROM sheet)", False), ("SELECT current_user", False),
    ("SELECT '${spark.app.id}'", False), ("SELECT * FROM sheet |> WHERE a > 1", False), ("SELECT * FROM (WITH x AS (SELECT a FROM sheet) SELECT * FROM x) y", True), ("SELECT -- nation\n a /* FROM nation */ FROM sheet", True),
    ("SELECT sum(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM sheet", True), ("SELECT (SELECT max(a) FROM sheet) - a FROM sheet UNION ALL SELECT 1", True), ("SELECT * FROM IDENTIFIER('nation')", False),
    ("SELECT a FROM sheet GROUP BY GROUPING SETS ((a), ())", True), ("SELECT a FROM sheet LATERAL VIEW explode(b) t", False), ("SELECT * FROM ((nation))", False), ("SELECT * FROM (sheet CROSS JOIN sheet t)", True), ("SELECT '", False),
)


@query("sandbox_guard", "SELECT * FROM (VALUES " + ", ".join(f"('{s.replace(chr(39), chr(39) * 2)}', {str(ok).lower()})" for s, ok in GUARDED) + ") v(statement, accepted)")
def sandbox_guard(spark, sf):
    """Which statements the guard accepts."""

    def accepted(statement: str) -> bool:
        try:
            sandbox.validate(statement)
        except sandbox.SqlRejected:
            return False
        return True

    return spark.createDataFrame([(s, accepted(s)) for s, _ in GUARDED], "statement string, accepted boolean")

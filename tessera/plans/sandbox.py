"""Guarded SQL over one table: the text must be a single SELECT over the view `sheet`.

Spark parses the statement, and its plan is walked before it is analysed: every node and expression
must be of a listed class, every relation the sheet or a common table expression that is in scope
there, every function a listed one. What the analyser makes of it is walked again: all leaves must be
the sheet's, and no user-defined function, reflection, session variable or name of the session may
have taken the place of a column or of a listed function.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that a statement may not hold, in upper or lower case, literals included.
FORBIDDEN = ("DROP", "CREATE", "INSERT", "UPDATE", "DELETE", "ALTER", "COPY", "PRAGMA", "ATTACH", "DETACH", "VACUUM", "EXPORT", "IMPORT")
# Rows that are shown, and seconds that a statement may take.
MOST_ROWS = 100
MOST_SECONDS = 5.0

#: Functions that a statement may call.
FUNCTIONS = frozenset(
    # aggregates and windows
    "any any_value approx_count_distinct avg bool_and bool_or corr count count_if covar_pop covar_samp cume_dist dense_rank every first first_value grouping grouping_id kurtosis lag last last_value lead "
    "listagg max max_by mean median min min_by mode nth_value ntile percent_rank percentile percentile_approx percentile_cont percentile_disc quantile rank regr_intercept regr_slope row_number skewness some "
    "std stddev stddev_pop stddev_samp string_agg sum try_avg try_sum var_pop var_samp variance "
    # numbers
    "between abs acos asin atan atan2 cbrt ceil ceiling cos degrees exp floor greatest hypot least ln log log10 log2 mod negative pi pmod positive pow power radians round bround sign signum sin sqrt tan trunc try_add "
    "try_divide try_multiply try_subtract width_bucket "
    # texts
    "ascii btrim char char_length character_length chr concat concat_ws contains endswith initcap instr left length levenshtein like locate lower lcase lpad ltrim octet_length overlay position printf "
    "regexp_count regexp_extract regexp_extract_all regexp_instr regexp_like regexp_replace regexp_substr repeat replace reverse right rpad rtrim soundex split split_part startswith substr substring "
    "substring_index translate trim ucase upper "
    # dates and times
    "add_months date date_add date_diff date_format date_part date_sub date_trunc datediff day dayname dayofmonth dayofweek dayofyear extract hour last_day make_date make_timestamp minute month "
    "months_between monthname next_day quarter second to_date to_timestamp try_to_date try_to_timestamp timestamp unix_timestamp weekday weekofyear year "
    # choices, casts and arrays
    "array array_agg array_contains array_distinct array_join array_max array_min array_size array_sort bigint boolean cast char coalesce collect_list collect_set decimal double element_at float if "
    "ifnull int isnan isnotnull isnull nanvl nullif nvl nvl2 size smallint sort_array string tinyint try_cast to_number try_to_number typeof varchar zeroifnull".split()
)
#: Classes of the parser's plans that a statement may consist of.
_NODES = frozenset(
    "Aggregate Distinct Except Filter GlobalLimit Intersect Join LimitAll LocalLimit LocalRelation Offset OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition".split()
)
#: Classes of the parser's expressions that a statement may consist of.
_EXPRESSIONS = frozenset(
    # names and values
    "Alias AttributeReference Cast CreateNamedStruct Literal UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedOrdinal UnresolvedStar UnresolvedStarExceptOrReplace "
    # numbers, comparisons and texts
    "Add And BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Concat Divide EqualNullSafe EqualTo GreaterThan GreaterThanOrEqual ILike If In IntegralDivide IsNotNull IsNull LessThan LessThanOrEqual Like "
    "LikeAll LikeAny Multiply Not NotLikeAll NotLikeAny Or Overlay RLike Remainder StringLocate StringTrim StringTrimBoth StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive "
    # groups, orders and windows
    "Cube CurrentRow GroupingSets Rollup SortOrder SpecifiedWindowFrame UnboundedFollowing UnboundedPreceding UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition "
    # subqueries
    "Exists InSubquery ListQuery ScalarSubquery".split()
)
#: Leaves of an analysed plan that hold nothing from outside of the statement.
_LEAVES = frozenset(("CTERelationRef", "LocalRelation", "OneRowRelation", "UnionLoopRef"))
#: Names that are values of the session where no column has them.
_SESSION = frozenset("current_user session_user current_catalog current_database current_schema current_path".split())
#: Analysed expressions that reach beyond the sheet.
_OUTSIDE = frozenset(
    "CallMethodViaReflection TryReflect CurrentCatalog CurrentDatabase CurrentUser InputFileBlockLength InputFileBlockStart InputFileName PythonUDAF PythonUDF PythonUDTF ScalaAggregator ScalaUDAF ScalaUDF "
    "SparkVersion SQLFunctionExpression SQLScalarFunction UserDefinedExpression VariableReference".split()
)
_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|[rR]?'(?:[^'\\]|\\.|'')*'|[rR]?\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|(?P<sign>\|>|;)|.", re.S)


class SqlRejected(ValueError):
    pass


class SqlTimeout(RuntimeError):
    pass


def _items(found: JavaObject) -> Iterator[JavaObject]:
    for i in range(found.size()):
        yield found.apply(i)


def _class(found: JavaObject) -> str:
    return found.getClass().getSimpleName().rstrip("$")


def _check_parsed(node: JavaObject, known: frozenset[str]) -> None:
    """Raises SqlRejected where an unresolved plan reaches beyond `known`, the relations in scope, and the listed functions."""
    kind = _class(node)
    if kind not in _NODES:
        raise SqlRejected(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        name = [str(x).lower() for x in _items(node.multipartIdentifier())]
        if len(name) != 1 or name[0] not in known:
            raise SqlRejected(f"{'.'.join(name)} is not the sheet")
    if kind == "UnresolvedWith":  # a common table expression sees those before it, and itself where it is recursive
        for own in _items(node.innerChildren()):
            name = str(own.alias()).lower()
            _check_parsed(own, known | {name} if node.allowRecursion() else known)
            known = known | {name}
    if kind == "WithWindowDefinition":
        for e in _items(node.windowDefinitions().values().toSeq()):
            _check_expression(e, known)
    for e in _items(node.expressions()):
        _check_expression(e, known)
    for child in _items(node.children()):
        _check_parsed(child, known)


def _check_expression(found: JavaObject, known: frozenset[str]) -> None:
    kind = _class(found)
    if kind not in _EXPRESSIONS:
        raise SqlRejected(f"{kind} is not allowed")
    if kind == "UnresolvedFunction":
        name = [str(x).lower() for x in _items(found.nameParts())]
        if len(name) != 1 or name[0] not in FUNCTIONS:
            raise SqlRejected(f"{'.'.join(name)} is not a function here")
    if kind == "UnresolvedAttribute":
        name = [str(x).lower() for x in _items(found.nameParts())]
        if "_metadata" in name or len(name) == 1 and name[0] in _SESSION:
            raise SqlRejected(f"{'.'.join(name)} is not a column")
    if kind in ("Exists", "ListQuery", "ScalarSubquery"):
        _check_parsed(found.plan(), known)
    for child in _items(found.children()):
        _check_expression(child, known)


def _check_analysed(node: JavaObject, sheet: str) -> None:
    """Raises SqlRejected where an analysed plan has a leaf or an expression that isn't the sheet's or the statement's own."""
    kind = _class(node)
    if kind == "SubqueryAlias" and str(node.alias()).lower() == sheet:
        return
    if node.children().isEmpty() and kind not in _LEAVES:
        raise SqlRejected(f"{kind} is not the sheet")
    stack = list(_items(node.expressions()))
    while stack:
        found = stack.pop()
        if _class(found) in _OUTSIDE:
            raise SqlRejected(f"{_class(found)} is not allowed")
        if _class(found) in ("Exists", "ListQuery", "ScalarSubquery", "LateralSubquery"):
            _check_analysed(found.plan(), sheet)
        stack.extend(_items(found.children()))
    for child in _items(node.children()):
        _check_analysed(child, sheet)


def validate(sql: str, spark: SparkSession | None = None) -> str:
    """The statement without white space and semicolon at its end, or SqlRejected. Spark's parser reads it."""
    text = (sql or "").strip()
    if not text:
        raise SqlRejected("empty statement")
    if not text.upper().startswith("SELECT"):
        raise SqlRejected("only SELECT is allowed")
    if found := re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", text):
        raise SqlRejected(f"{found[1].upper()} is not allowed")
    if "${" in text:
        raise SqlRejected("variables are not allowed")
    text = text.removesuffix(";").rstrip()
    if any(m.lastgroup for m in _TOKEN.finditer(text)):
        raise SqlRejected("only one statement without pipes is allowed")
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise SqlRejected(f"unreadable: {str(error).splitlines()[0]}") from error
    _check_parsed(plan, frozenset(("sheet",)))
    return text


def select(sheet: DataFrame, sql: str) -> DataFrame:
    """The result of a guarded statement over `sheet`."""
    spark, name = sheet.sparkSession, f"sheet_{uuid.uuid4().hex}"
    text = validate(sql, spark)
    on_files = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    sheet.createOrReplaceTempView(name)
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        out = spark.sql(f"WITH sheet AS (SELECT * FROM {name}) {text}")
        _check_analysed(out._jdf.queryExecution().analyzed(), name)
        return out
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", on_files)
        spark.catalog.dropTempView(name)


def rendered(result: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """At most `most` rows as strings, with how many rows there were and whether some are missing."""
    total = result.select(F.count(F.lit(1)).alias("raw_rows"))
    rows = result.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in result.columns)).limit(most)
    return rows.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("raw_rows") > most)


@dataclass(frozen=True)
class Computed:
    """What a statement gave: columns, rows as strings, how many rows there were, milliseconds, whether rows are missing."""

    asset_id: str
    columns: list[str]
    rows: list[list[str]]
    raw_rows: int
    elapsed_ms: float
    truncated: bool

    def markdown(self) -> str:
        """The block that goes into a prompt. Its wording is a fixed format."""
        out = [f"[TABLE_COMPUTE_RESULT:asset_id={self.asset_id}]", f"Computation executed in {self.elapsed_ms:.0f}ms. Returned {self.raw_rows} rows."]
        if self.truncated:
            out.append(f"(Showing first {len(self.rows)} rows of {self.raw_rows} total)")
        out.append("")
        if self.columns and self.rows:
            out += [f"| {' | '.join(self.columns)} |", "|" + "---|" * len(self.columns), *(f"| {' | '.join(map(str, r))} |" for r in self.rows)]
        return "\n".join(out)


def compute(sheet: DataFrame, sql: str, asset_id: str = "", seconds: float = MOST_SECONDS, most: int = MOST_ROWS) -> Computed:
    """Runs a guarded statement; its jobs are cancelled after `seconds`, which is a SqlTimeout.

    At most `most` rows come to the driver, and their number.
    """
    sc, tag = sheet.sparkSession.sparkContext, f"sandbox-{uuid.uuid4().hex}"
    result, late = select(sheet, sql), threading.Event()
    columns = result.columns

    def cancel() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer, began = threading.Timer(seconds, cancel), time.perf_counter()
    sc.addJobTag(tag)
    timer.start()
    try:
        rows = [[str(x) for x in r] for r in result.limit(most + 1).collect()]
        n = len(rows) if len(rows) <= most else result.count()
    except Exception as error:
        if late.is_set():
            raise SqlTimeout(f"not done within {seconds} s") from error
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    return Computed(asset_id, columns, rows[:most], n, (time.perf_counter() - began) * 1000, n > most)

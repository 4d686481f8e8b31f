"""SQL over a collection's own tables: checked, then run read-only.

Text is checked first (one SELECT, no forbidden word, no system catalog), then
the plan Spark's parser makes of it: only nodes and functions known to be
harmless, only relations of one name that is a table of the collection or a
query named in scope, and at least one table. What can't be parsed, or not
within the time allowed, is turned away.
"""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor, TimeoutError as ParseTimeout

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import QueryError
from tessera.functions.json_text import recover_json
from tessera.functions.values import sanitized, table_name
from tessera.model import Column
from tessera.operators.filters import Collection

#: Words and names that are turned away wherever they stand.
FORBIDDEN = re.compile(r"\b(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE|TRUNCATE|GRANT|REVOKE|EXEC|EXECUTE|COPY|VACUUM)\b", re.IGNORECASE)
SYSTEM = re.compile(r"\b(pg_catalog|information_schema|pg_[a-z_]+)\b", re.IGNORECASE)
REFUSAL = "That doesn't look like a question about your data — try asking about a specific field, value or document."
#: Longest statement that is parsed, and the seconds parsing may take.
MAX_SQL, PARSE_SECONDS = 20_000, 2.0
#: Plan nodes a query may have.
ALLOWED = frozenset(
    """
    Project Filter Join Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except
    SubqueryAlias UnresolvedWith UnresolvedRelation OneRowRelation LateralJoin WithWindowDefinition UnresolvedSubqueryColumnAliases
    UnresolvedOrdinal Pivot UnresolvedPivot Unpivot Window UnresolvedInlineTable LocalRelation ResolvedHint UnresolvedHint
    """.split()
)
#: Functions a query may call: of the value alone, without a way to the JVM,
#: files, the session or the user.
FUNCTIONS = frozenset(
    """
    abs acos any any_value approx_count_distinct array array_agg array_contains array_distinct array_join array_max array_min array_size array_sort
    ascii asin atan atan2 avg bool_and bool_or btrim cardinality cast ceil ceiling char_length character_length chr coalesce collect_list collect_set
    concat concat_ws contains corr cos count count_if covar_pop covar_samp cume_dist current_date current_timestamp date date_add date_diff date_format
    date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear decode degrees dense_rank element_at endswith every exp explode extract
    find_in_set first first_value floor format_number format_string from_unixtime get_json_object greatest grouping grouping_id hour if ifnull initcap
    instr isnan isnotnull isnull json_array_length kurtosis lag last last_day last_value lcase lead least left length levenshtein like listagg ln locate
    log log10 log2 lower lpad ltrim make_date map_keys map_values max max_by mean median min min_by minute mod mode month months_between named_struct
    nth_value ntile nullif nullifzero nvl nvl2 octet_length overlay percent_rank percentile percentile_approx percentile_cont percentile_disc pi position
    pow power quarter radians rank regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace regexp_substr repeat replace reverse right
    rint rlike round row_number rpad rtrim second sequence sign signum sin size skewness slice some sort_array soundex split split_part sqrt startswith
    std stddev stddev_pop stddev_samp string_agg strpos struct substr substring substring_index sum tan timestamp to_char to_date to_number to_timestamp
    translate trim trunc try_cast try_divide try_to_number typeof ucase upper var_pop var_samp variance weekday weekofyear width_bucket year zeroifnull
    boolean tinyint smallint int bigint float double decimal string
    + - * / % = == <=> < <= > >= != <> ! and or not || div & | ^ ~ in between
    """.split()
)
#: What may be unresolved in a parsed expression; anything else of that kind
#: (names made at run time, table functions) is turned away.
UNRESOLVED = frozenset(
    """
    UnresolvedAttribute UnresolvedFunction UnresolvedStar UnresolvedAlias UnresolvedExtractValue UnresolvedWindowExpression
    UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStarWithColumns UnresolvedStarExceptOrReplace UnresolvedInlineTable
    """.split()
)
#: Names Spark takes for functions where no column bears them; they tell of the session.
SESSION_NAMES = frozenset(("current_user", "session_user", "user", "current_catalog", "current_database", "current_schema"))


def _seq(items) -> list:
    return [items.apply(k) for k in range(items.size())]


class _Walk:
    def __init__(self, allowed: set[str], columns: set[str]) -> None:
        self.allowed, self.columns, self.touched = allowed, columns, False

    def expression(self, node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            parts = [str(p).lower() for p in _seq(node.nameParts())]
            if len(parts) != 1 or parts[0] not in FUNCTIONS:
                raise QueryError(f"Not allowed in a query: {'.'.join(parts)}()")
        elif kind == "UnresolvedAttribute":
            parts = [str(p).lower() for p in _seq(node.nameParts())]
            if len(parts) == 1 and parts[0] in SESSION_NAMES - self.columns:
                raise QueryError(f"Not allowed in a query: {parts[0]}")
        elif ("Unresolved" in kind and kind not in UNRESOLVED) or "Identifier" in kind or "Reflection" in kind or kind.startswith("Current") and kind not in ("CurrentDate", "CurrentTimestamp", "CurrentRow$"):
            raise QueryError(f"Not allowed in a query: {kind}")
        for child in _seq(node.children()):
            self.expression(child)

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in ALLOWED:
            raise QueryError(f"Not allowed in a query: {kind}")
        if kind == "UnresolvedRelation":
            parts = [str(p).lower() for p in _seq(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in self.allowed | scope:
                raise QueryError(f"Query references unauthorized table: {'.'.join(parts)}")
            self.touched |= parts[0] not in scope
            return
        if kind == "UnresolvedWith":
            for relation in _seq(node.cteRelations()):
                name = str(relation._1()).lower()
                inner = scope | {name} if node.allowRecursion() else scope
                self.plan(relation._2(), inner)
                scope = scope | {name}
        for expression in _seq(node.expressions()):
            self.expression(expression)
        for child in _seq(node.children()):
            self.plan(child, scope)
        for inner in _seq(node.subqueries()):
            self.plan(inner, scope)


def _parsed(spark: SparkSession, text: str):
    """Spark's unresolved plan of a statement, within ``PARSE_SECONDS``."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    parser.parsePlan("SELECT 1")  # what the first call loads isn't the statement's fault
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(parser.parsePlan, text).result(PARSE_SECONDS)
    except ParseTimeout:
        raise QueryError("Generated SQL took too long to parse") from None
    except Exception as error:
        raise QueryError("Generated SQL could not be parsed for validation", str(error)[:200]) from None
    finally:
        pool.shutdown(wait=False)


def check_sql(spark: SparkSession, sql: str, allowed: set[str], columns: set[str] = frozenset()) -> str:
    """The statement without a closing semicolon; raises what is wrong with it.
    ``columns`` are the tables' columns, which may be called like the session's user."""
    # The wording of what is turned away, here and in the walk.
    text = sql.strip()
    if not text.upper().startswith(("SELECT", "WITH")):
        raise QueryError("Only SELECT queries are allowed")
    if found := FORBIDDEN.search(text):
        raise QueryError(f"Query contains forbidden operation: {found.group(1).upper()}")
    text = text.removesuffix(";")
    if ";" in text:
        raise QueryError("Multiple SQL statements are not allowed")
    if found := SYSTEM.search(text):
        raise QueryError(f"Query references system tables: {found.group(1)}")
    if len(text) > MAX_SQL:
        raise QueryError("The query is too long")
    text = _spark_types(text)
    plan = _parsed(spark, _bare_quotes(text))
    walk = _Walk({a.lower() for a in allowed}, {c.lower() for c in columns})
    walk.plan(plan, frozenset())
    if not walk.touched:
        raise QueryError("Query must reference the collection's tables")
    return text


def _outside_literals(text: str, change) -> str:
    """Apply ``change`` to the parts of a statement outside single quotes."""
    return "".join(p if k % 2 else change(p) for k, p in enumerate(re.split(r"('(?:[^']|'')*')", text)))


def _spark_types(text: str) -> str:
    return _outside_literals(text, lambda p: re.sub(r"::\s*text\b", "::string", p, flags=re.IGNORECASE))


def _bare_quotes(text: str) -> str:
    """Identifiers in double quotes as Spark writes them."""
    return _outside_literals(text, lambda p: re.sub(r'"([^"`]+)"', r"`\1`", p))


def collection_tables(collection_id: str, collection: Collection) -> dict[str, DataFrame]:
    return {table_name(collection_id): collection.main} | {table_name(collection_id, n): df for n, df in collection.children.items()}


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Check a statement and run it over views of the tables given."""
    text = _bare_quotes(check_sql(spark, sql, set(tables), {c for df in tables.values() for c in df.columns}))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def describe_tables(collection_id: str, columns: list[Column], parent: str | None = None, at: str = "") -> str:
    """The tables as a prompt shows them, children with the join to their parent."""
    name = parent and table_name(collection_id, at) or table_name(collection_id)
    scalars = ", ".join(f"{sanitized(c.name)} {c.type}" for c in columns if c.type != "entity_array")
    lines = [f"{name}(_row_id, {'_parent_row_id, ' if parent else ''}_document_id, {scalars})" + (f" -- join: {name}._parent_row_id = {parent}._row_id" if parent else "")]
    for c in columns:
        if c.type == "entity_array":
            lines.append(describe_tables(collection_id, c.children, name, f"{at}_{c.name}" if at else c.name))
    return "\n".join(lines)


def read_verdict(envelope: str | None) -> tuple[str | None, str]:
    """(sql, explanation) of a model's plan, or (None, reason) of a refusal.
    What can't be read, and an answer without SQL, is a refusal."""
    body = recover_json(envelope)
    if not isinstance(body, dict):
        return None, REFUSAL
    answerable = body.get("answerable")
    if isinstance(answerable, str):
        answerable = {"true": True, "false": False}.get(answerable.strip().lower())
    sql = body.get("sql")
    if answerable is True and isinstance(sql, str) and sql.strip():
        return sql, str(body.get("explanation") or "")
    reason = body.get("reason")
    return None, reason if isinstance(reason, str) and reason.strip() else REFUSAL


def ask(spark: SparkSession, envelope: str | None, tables: dict[str, DataFrame]) -> tuple[DataFrame | None, str]:
    """Rows that answer a question by its model's plan, or None and why not;
    a refusal runs no SQL."""
    sql, said = read_verdict(envelope)
    return (None, said) if sql is None else (run_sql(spark, sql, tables), said)


def phrase(headline: str, facts: dict, proposed: str | None) -> str:
    """A model's phrasing of an answer, unless it brings a number of its own."""
    known = headline + json.dumps(facts, ensure_ascii=False, default=str)
    if not proposed or not proposed.strip() or any(n not in known for n in re.findall(r"\d+(?:\.\d+)?", proposed)):
        return headline
    return proposed.strip()

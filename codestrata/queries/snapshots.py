"""Keyed diffs, first/last wins, operation diffs and renames, name resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import findings as fnd, ordered, snapshots, variables
from codestrata.queries import Catalog, table
from codestrata.functions.symbols import is_exported, is_imported

CATALOG = Catalog()
query = CATALOG.add

CUT = "1998-01-01"


def _customer_periods(spark, d):
    orders = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.to_timestamp(F.lit(CUT))

    def summary(df):
        return df.groupBy("o_custkey").agg(
            F.count(F.lit(1)).alias("n_orders"), F.max("o_orderstatus").alias("top_status")
        )

    return summary(orders.where(early)), summary(orders.where(~early))


PERIODS_SQL = f"""
  o AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderstatus) AS top_status FROM orders
        WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1),
  n AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderstatus) AS top_status FROM orders
        WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY 1)"""


@query(
    f"""
    WITH {PERIODS_SQL}
    SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey,
           CASE WHEN o.o_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'removed'
                WHEN o.n_orders = n.n_orders AND o.top_status = n.top_status THEN 'common'
                ELSE 'modified' END AS change,
           coalesce(n.n_orders, o.n_orders) AS n_orders, coalesce(n.top_status, o.top_status) AS top_status
    FROM o FULL JOIN n ON o.o_custkey = n.o_custkey
    """
)
def snapshot_diff(spark, d):
    old, new = _customer_periods(spark, d)
    return snapshots.snapshot_diff(old, new, ["o_custkey"])


def _line_halves(spark, d):
    """Shipments before and after the cut; (l_orderkey, l_linenumber) repeats on both sides."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_shipdate",
    )
    early = F.col("l_shipdate") < F.to_timestamp(F.lit(CUT))
    return lines.where(early), lines.where(~early)


LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]


@query(
    f"""
    WITH o AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'),
         n AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'),
         last AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
                           l_extendedprice DESC, l_returnflag DESC, l_linestatus DESC) = 1)
    SELECT n.l_orderkey, n.l_linenumber,
           CASE WHEN last.l_orderkey IS NULL THEN 'added'
                WHEN last.l_returnflag = n.l_returnflag AND last.l_linestatus = n.l_linestatus THEN 'common'
                ELSE 'modified' END AS change, n.l_returnflag, n.l_linestatus
    FROM n LEFT JOIN last USING (l_orderkey, l_linenumber)
    UNION ALL
    SELECT l_orderkey, l_linenumber, 'removed', l_returnflag, l_linestatus
    FROM o ANTI JOIN n USING (l_orderkey, l_linenumber)
    """
)
def snapshot_diff_dups(spark, d):
    old, new = _line_halves(spark, d)
    return snapshots.snapshot_diff(
        old, new, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus"], LINE_ORDER
    )


@query(
    f"""
    WITH {PERIODS_SQL}
    SELECT o.* FROM o ANTI JOIN n USING (o_custkey)
    """
)
def keys_only_in_old(spark, d):
    old, new = _customer_periods(spark, d)
    return snapshots.only_in(old, new, ["o_custkey"])


@query(f"WITH {PERIODS_SQL} SELECT * FROM o INTERSECT SELECT * FROM n")
def identical_rows(spark, d):
    old, new = _customer_periods(spark, d)
    return snapshots.identical_rows(old, new)


@query(
    """
    SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
    """
)
def first_wins(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return ordered.first_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    """
    SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
    """
)
def last_wins(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return ordered.last_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


def _kinds(df):
    kind = (
        F.when(F.col("event_type") == "view", "Function")
        .when(F.col("event_type") == "click", "Variable")
        .when(F.col("event_type") == "error", "Undefined")
        .otherwise("Other")
    )
    return df.select("event_id", kind.alias("type"), (F.col("value") > 10).alias("is_global"))


KINDS_SQL = """(SELECT event_id, CASE event_type WHEN 'view' THEN 'Function' WHEN 'click' THEN 'Variable'
    WHEN 'error' THEN 'Undefined' ELSE 'Other' END AS type, value > 10 AS is_global FROM events)"""


@query(f"SELECT * FROM {KINDS_SQL} WHERE is_global AND type <> 'Undefined'")
def exported_rows(spark, d):
    return fnd.filter_rows(
        _kinds(table(spark, d, "events")), lambda df: is_exported(df["is_global"], df["type"])
    )


@query(f"SELECT * FROM {KINDS_SQL} WHERE type = 'Undefined'")
def imported_rows(spark, d):
    return fnd.filter_rows(_kinds(table(spark, d, "events")), lambda df: is_imported(df["type"]))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def union_of_parts(spark, d):
    """Two parts by a rule that every row, also one without a language, satisfies or not."""
    docs = table(spark, d, "documents").select("lang", "n_chars")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    whole = snapshots.union_all([docs.where(english), docs.where(~english)])
    return whole.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _turn_words(spark, d, asked):
    """Words of the user's turns, or of all others."""
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    turns = table(spark, d, "conversations").where(user if asked else ~user)
    return turns.select(F.col("conv_id"), F.explode(F.array_distinct(F.split("text", " "))).alias("op"))


WORDS_SQL = """
  u AS (SELECT DISTINCT conv_id, unnest(string_split(text, ' ')) AS op FROM conversations WHERE role = 'user'),
  a AS (SELECT DISTINCT conv_id, unnest(string_split(text, ' ')) AS op FROM conversations WHERE role IS DISTINCT FROM 'user'),
  diff AS (
    SELECT conv_id, 'removed' AS change, op FROM u ANTI JOIN a USING (conv_id, op)
    WHERE conv_id IN (SELECT conv_id FROM a)
    UNION ALL
    SELECT conv_id, 'added' AS change, op FROM a ANTI JOIN u USING (conv_id, op)
    WHERE conv_id IN (SELECT conv_id FROM u))"""


@query(f"WITH {WORDS_SQL} SELECT * FROM diff")
def op_diff(spark, d):
    return variables.variable_diff(_turn_words(spark, d, True), _turn_words(spark, d, False), ["conv_id"])


@query(f"WITH {WORDS_SQL} SELECT DISTINCT conv_id FROM diff")
def changed_names(spark, d):
    return variables.changed_names(op_diff(spark, d), ["conv_id"])


@query(f"WITH {WORDS_SQL} SELECT op, count(*) AS n FROM diff WHERE change = 'added' GROUP BY op")
def added_ops(spark, d):
    added = op_diff(spark, d).where(F.col("change") == "added")
    return fnd.id_counts(added, "op", "n")


@query(
    """
    SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, CASE WHEN a.conv_id IS NULL THEN 'old' ELSE 'new' END AS side
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') u
    FULL JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role IS DISTINCT FROM 'system') a USING (conv_id)
    WHERE u.conv_id IS NULL OR a.conv_id IS NULL
    """
)
def one_sided_names(spark, d):
    """Conversations with a system turn against those with a turn of anyone else."""
    turns = table(spark, d, "conversations").select("conv_id", "role", "turn")
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    return variables.one_sided(turns.where(system), turns.where(~system), ["conv_id"])


@query(
    """
    WITH w AS (SELECT DISTINCT d.doc_id, d.lang, l.doc_id IS NOT NULL AS labelled,
                      unnest(string_split(text, ' ')) AS op
               FROM documents d LEFT JOIN labels l USING (doc_id)),
         s AS (SELECT lang, doc_id, labelled, string_agg(op, chr(1) ORDER BY op) AS ops FROM w GROUP BY ALL),
         g AS (SELECT lang, ops, count(*) FILTER (WHERE labelled) AS n_old, count(*) FILTER (WHERE NOT labelled) AS n_new,
                      min(doc_id) FILTER (WHERE labelled) AS old_name, min(doc_id) FILTER (WHERE NOT labelled) AS new_name
               FROM s GROUP BY ALL)
    SELECT lang, old_name, new_name FROM g WHERE n_old = 1 AND n_new = 1
    """
)
def op_renames(spark, d):
    """Labelled documents whose word set equals that of exactly one unlabelled document."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    labelled = table(spark, d, "labels").select("doc_id").distinct()

    def words(df):
        return df.select("lang", F.col("doc_id").alias("var"), F.explode(F.array_distinct(F.split("text", " "))).alias("op"))

    return variables.rename_candidates(
        words(docs.join(labelled, "doc_id", "left_semi")),
        words(docs.join(labelled, "doc_id", "left_anti")),
        within=["lang"],
    )


@query(
    """
    WITH g AS (SELECT lang, source, max(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN 'local' WHEN g.quality IS NOT NULL THEN 'global'
                          ELSE 'unresolved' END AS scope, coalesce(l.quality, g.quality) AS quality
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN g ON d.lang = g.lang AND d.source = g.source
    """
)
def resolve_names(spark, d):
    """A document's own label, else the best one known for its language and source, else unresolved."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    shared = (
        labels.join(docs, "doc_id")
        .groupBy("lang", "source")
        .agg(F.max("quality").alias("quality"))
    )
    return variables.resolve_names(docs, labels, shared, ["doc_id"], ["lang", "source"], "quality").select(
        "doc_id", "scope", "quality"
    )


def _event_uses(spark, d):
    events = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write")
    return events.select(
        F.col("user_id"), F.col("event_type").alias("function"), F.col("event_id").alias("inst_id"), kind.alias("use_kind")
    )


@query(
    """
    SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS reads,
           count(*) FILTER (WHERE event_type = 'purchase') AS writes
    FROM events GROUP BY user_id
    """
)
def rw_counts(spark, d):
    return variables.rw_counts(_event_uses(spark, d), ["user_id"])


@query(
    """
    SELECT c_custkey, count(DISTINCT o_orderkey) AS uses
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    """
)
def use_counts(spark, d):
    """Distinct orders per customer; customers without orders count 0."""
    names = table(spark, d, "customer").select("c_custkey")
    uses = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("inst_id"))
    return variables.use_counts(names, uses, ["c_custkey"])


@query(
    """
    WITH c AS (SELECT user_id AS module, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS fn,
                      count(*) FILTER (WHERE value > 10) AS r, count(*) FILTER (WHERE value <= 10) AS w
               FROM events GROUP BY ALL),
         e AS (SELECT module, fn, '{"v":{"read":[' || coalesce(rtrim(repeat('"v",', CAST(r AS INTEGER)), ','), '')
                      || '],"write":[' || coalesce(rtrim(repeat('"v",', CAST(w AS INTEGER)), ','), '') || ']}}' AS body FROM c)
    SELECT module, '{"global_var":' || coalesce(max(body) FILTER (WHERE fn IS NULL), '{}') || ',"function_var":{'
           || coalesce(string_agg('"' || fn || '":' || body, ',' ORDER BY fn) FILTER (WHERE fn IS NOT NULL), '') || '}}' AS report
    FROM e GROUP BY module
    """
)
def rw_report(spark, d):
    """Per user: variable ``v`` used by each event type; errors stand for the global scope."""
    events = table(spark, d, "events").select(
        F.col("user_id").alias("module"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("function"),
        F.lit("v").alias("var"),
        F.when(F.col("value") > 10, "read").otherwise("write").alias("use_kind"),
    )
    return variables.variable_report(variables.rw_counts(events, ["module", "function", "var"]))

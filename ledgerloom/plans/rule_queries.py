"""The classification cascade over line-item transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, text
from ledgerloom.operators import recurrence as recur
from ledgerloom.operators import rules
from ledgerloom.operators.rollups import sum_if
from ledgerloom.plans import bindings as b
from ledgerloom.plans.registry import query
from ledgerloom.session import stored

RAW = [
    "owner_id", "txn_id", "document_id", "institution_id", "own_account_id", "txn_date", "amount", "currency",
    "raw_description", "counterparty_raw", "fy_key",
]
READ = ["owner_id", "txn_id", "txn_date", "amount", "raw_description"]  # what the cascade reads of them


def raw_rows(spark, sf_dir):
    return b.ledger_lines(spark, sf_dir).select(*RAW)


# -------------------------------------------------------------------------- rule tables
def pick(words, index):
    return F.get(F.array(*[F.lit(w) for w in words]), (index % len(words)).cast("int"))


def name_of(owner, shift):
    return F.concat(pick(b.COLORS, owner + shift), F.lit(" "), pick(b.GOODS, owner * 3 + shift))


def owners(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    return c.select(F.floor(F.col("c_custkey") / b.ACCOUNTS_PER_OWNER).cast("bigint").alias("owner_id")).distinct()


def household_records(spark, sf_dir):
    """Declared household records in major units, as a profile form would hold them."""
    o = F.col("owner_id")

    def items(when, *structs):
        return F.when(when, F.array(*structs)).otherwise(F.slice(F.array(*structs), 1, 0))

    def s(**fields):
        return F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items()])

    def date(value):
        return F.lit(value).cast("date")

    no_text = F.lit(None).cast("string")
    no_money = F.lit(None).cast("double")
    broker = s(institution_id=F.concat(F.lit("supplier#00000009"), o % 10), name=name_of(o, 5), tax_section=F.lit("80C"))
    platform = s(institution_id=F.lit("platform"), name=name_of(o, 9), tax_section=no_text)
    return owners(spark, sf_dir).select(
        "owner_id",
        F.when(
            o % 2 == 0,
            s(
                name=F.concat(F.lit("Employer "), o),
                aliases=F.when(o % 4 == 0, F.array(name_of(o, 0), name_of(o, 1))).otherwise(F.array().cast("array<string>")),
                monthly_net_salary=F.lit(50000.0),
            ),
        ).alias("employer"),
        s(
            landlord_name=F.when(o % 6 != 2, F.concat(F.lit("Supplier#"), F.lpad((o % 100).cast("string"), 9, "0"))),
            monthly_rent=F.when(o % 3 != 0, F.lit(30000.0)),
        ).alias("home"),
        items(
            F.lit(True),
            s(name=name_of(o, 2), role="cook", monthly_amount=F.lit(20000.0), upi_handle=no_text),
            s(name=name_of(o, 3), role="driver", monthly_amount=no_money, upi_handle=name_of(o, 4)),
        ).alias("house_help"),
        items(
            o % 4 == 1,
            s(institution_id=no_text, kind="home", emi_amount=F.lit(40000.0)),
            s(institution_id=no_text, kind="auto", emi_amount=F.lit(40500.55)),
        ).alias("loans"),
        items(
            o % 3 == 0,
            s(institution_id=no_text, last4=F.lpad((o * 7 % 10000).cast("string"), 4, "0"), nickname=F.when(o % 2 == 0, name_of(o, 7))),
        ).alias("cards"),
        items(F.lit(True), broker).alias("brokers"),
        items(o % 2 == 1, platform).alias("investment_platforms"),
        items(o % 5 != 0, s(institution_id=no_text, name=name_of(o, 6), kind="health", tax_section="80D")).alias("insurers"),
        items(
            o % 5 == 0,
            s(id="p0", name="undated", start_date=F.lit(None).cast("date"), end_date=date("1999-01-01"), category_hints=F.array(F.lit("x"))),
            s(id="p1", name="repair", start_date=date("1997-01-01"), end_date=date("1997-12-31"), category_hints=F.array(F.lit("blue"), F.lit("Utilities"))),
            s(id="p2", name="move", start_date=date("1997-06-01"), end_date=date("1998-06-30"), category_hints=F.array().cast("array<string>")),
        ).alias("projects"),
    )


def profiles(spark, sf_dir):
    return rules.build_signals(household_records(spark, sf_dir))


def sql_pick(words, index: str) -> str:
    return f"{words!r}[({index}) % {len(words)} + 1]"


def sql_name(shift: int) -> str:
    return f"({sql_pick(b.COLORS, f'owner_id + {shift}')} || ' ' || {sql_pick(b.GOODS, f'owner_id * 3 + {shift}')})"


SQL_PROFILES = f"""
owners AS (SELECT DISTINCT CAST(floor(c_custkey / {b.ACCOUNTS_PER_OWNER}) AS BIGINT) AS owner_id FROM customer),
profiles AS (SELECT owner_id,
  CASE WHEN owner_id % 2 = 0 THEN 'Employer ' || owner_id END AS employer,
  CASE WHEN owner_id % 4 = 0 THEN {sql_name(0)} WHEN owner_id % 2 = 0 THEN lower('Employer ' || owner_id) END AS employer_alias,
  CASE WHEN owner_id % 4 = 0 THEN {sql_name(1)} WHEN owner_id % 2 = 0 THEN lower('Employer ' || owner_id) END AS employer_alias_2,
  5000000 AS salary,
  CASE WHEN owner_id % 6 <> 2 THEN lower('Supplier#' || lpad((owner_id % 100)::VARCHAR, 9, '0')) END AS landlord,
  CASE WHEN owner_id % 3 <> 0 THEN 3000000 END AS rent,
  {sql_name(2)} AS cook, {sql_name(3)} AS driver, {sql_name(4)} AS driver_handle,
  owner_id % 4 = 1 AS has_loans,
  CASE WHEN owner_id % 3 = 0 THEN lpad((owner_id * 7 % 10000)::VARCHAR, 4, '0') END AS last4,
  CASE WHEN owner_id % 3 = 0 THEN CASE WHEN owner_id % 2 = 0 THEN {sql_name(7)} ELSE '··' || lpad((owner_id * 7 % 10000)::VARCHAR, 4, '0') END END AS card_label,
  {sql_name(5)} AS broker, 'supplier#00000009' || (owner_id % 10) AS broker_id,
  CASE WHEN owner_id % 2 = 1 THEN {sql_name(9)} END AS platform,
  CASE WHEN owner_id % 5 <> 0 THEN {sql_name(6)} END AS insurer,
  owner_id % 5 = 0 AS has_projects FROM owners)"""


def aliases(spark, sf_dir):
    """Merchant rules from part names: some whole names, some single words, one very short."""
    names = b.table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    color, good = F.split("name", " ")[0], F.split("name", " ")[1]
    whole = names.filter(color.isin("red", "blue", "old")).select(
        F.col("name").alias("pattern"), F.initcap("name").alias("canonical_merchant"),
        F.concat(F.lit("expenses."), color).alias("category"), good.alias("subcategory"), F.lit("pack:in").alias("source"),
    )
    words = names.filter(good.isin("widget", "gizmo", "rod")).select(
        good.alias("pattern"), F.concat(F.initcap(good), F.lit(" Co")).alias("canonical_merchant"),
        F.when(good == "gizmo", "investment.mutual_fund").otherwise("subscriptions.quick_commerce").alias("category"),
        F.when(good == "rod", "daily_use").alias("subcategory"), F.lit("user").alias("source"),
    ).distinct()
    # equal lengths are decided by position; a code-point order keeps it the same on every engine
    return whole.unionByName(words).withColumns({"confidence": F.lit("high"), "seq": F.col("pattern")})


SQL_ALIASES = """
names AS (SELECT DISTINCT lower(p_name) AS name, split_part(lower(p_name), ' ', 1) AS color, split_part(lower(p_name), ' ', 2) AS good FROM part),
aliases AS (
  SELECT name AS pattern, upper(color[1]) || color[2:] || ' ' || upper(good[1]) || good[2:] AS canonical_merchant,
    'expenses.' || color AS category, good AS subcategory, 'pack:in' AS source,
    upper(color[1]) || color[2:] AS shown FROM names WHERE color IN ('red', 'blue', 'old')
  UNION ALL
  SELECT DISTINCT good, upper(good[1]) || good[2:] || ' Co', CASE WHEN good = 'gizmo' THEN 'investment.mutual_fund' ELSE 'subscriptions.quick_commerce' END,
    CASE WHEN good = 'rod' THEN 'daily_use' END, 'user', CASE WHEN good = 'gizmo' THEN 'Mutual Fund' ELSE 'Quick Commerce' END
  FROM names WHERE good IN ('widget', 'gizmo', 'rod'))"""


def overrides(spark, sf_dir):
    """User rules learnt from a sample of line items; the first rule of a signature counts."""
    rows = b.ledger_lines(spark, sf_dir).filter(F.col("txn_id").rlike("^t[0-9]*7_1_"))
    return rows.select(
        "owner_id", text.signature(F.col("raw_description")).alias("match_signature"), F.col("txn_id").alias("seq"),
        F.when(F.col("txn_id").endswith("1"), "transfer").alias("flow"),
        F.when(F.col("amount") % 3 != 0, F.when(F.col("amount") % 2 == 0, "Investment").otherwise("Dining")).alias("category"),
        F.lit(None).cast("string").alias("subcategory"), F.concat(F.lit("Mine "), "document_id").alias("merchant"),
        F.lit(None).cast("string").alias("tax_section"), F.lit("checked").alias("note"),
    )


SQL_OVERRIDES = f"""
raw AS (SELECT {', '.join(RAW)}, {b.sql_clean('raw_description')} AS cleaned, {b.sql_signature('raw_description')} AS signature FROM ledger_lines),
overrides AS (SELECT owner_id, signature, arg_min(txn_id, txn_id) AS rule_id,
    arg_min([CASE WHEN txn_id LIKE '%1' THEN 'transfer' END], txn_id)[1] AS o_flow,
    arg_min([CASE WHEN amount % 3 <> 0 THEN CASE WHEN amount % 2 = 0 THEN 'Investment' ELSE 'Dining' END END], txn_id)[1] AS o_category,
    arg_min('Mine ' || document_id, txn_id) AS o_merchant
  FROM raw WHERE regexp_matches(txn_id, '^t[0-9]*7_1_') AND signature <> '' GROUP BY ALL)"""

SQL_RHYTHM = f"""
rhythm AS (SELECT owner_id, signature, cadence, occurrences FROM (
  SELECT owner_id, signature, count(*)::BIGINT AS occurrences,
    CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY abs(amount) DESC) AS BIGINT) AS median_amount,
    CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY gap DESC) AS BIGINT) AS median_gap,
    CASE WHEN median_gap BETWEEN 25 AND 35 THEN 'monthly' WHEN median_gap BETWEEN 80 AND 100 THEN 'quarterly' WHEN median_gap BETWEEN 350 AND 380 THEN 'yearly' END AS cadence
  FROM (SELECT *, date_diff('day', lag(txn_date) OVER (PARTITION BY owner_id, signature ORDER BY txn_date, txn_id), txn_date) AS gap FROM raw WHERE amount < 0)
  WHERE signature <> '' AND NOT regexp_matches(signature, '{fv.STRUCTURAL_RECURRENCE_PATTERN}') GROUP BY ALL)
  WHERE occurrences >= 3 AND median_amount <= 2500000 AND cadence IS NOT NULL)"""

SQL_LOOKUPS = """
alias_hits AS (SELECT cleaned, arg_min({p: pattern, m: canonical_merchant, c: category, s: subcategory, u: source, d: shown}, (-length(pattern), pattern)) AS a,
    max(length(pattern)) >= 5 AS evidence
  FROM (SELECT DISTINCT cleaned FROM raw) JOIN aliases ON contains(cleaned, pattern) GROUP BY cleaned),
looked AS (SELECT raw.*, profiles.* EXCLUDE (owner_id), a, coalesce(evidence, false) AS evidence, rule_id, o_flow, o_category, o_merchant, cadence, occurrences
  FROM raw LEFT JOIN profiles USING (owner_id) LEFT JOIN overrides USING (owner_id, signature)
  LEFT JOIN rhythm USING (owner_id, signature) LEFT JOIN alias_hits USING (cleaned))"""


def near(amount: str, target: str, tolerance: float) -> str:
    return f"(abs(abs({amount}) - {target}) <= {target} * {tolerance})"


def has(needle: str) -> str:
    return f"coalesce(contains(cleaned, {needle}), false)"


EMI_HOME, EMI_AUTO = near("amount", "4000000", 0.02), near("amount", "4050055", 0.02)
# layer name -> (condition, column values); null where a column is not named
SQL_LAYERS = {
    "override": (
        "rule_id IS NOT NULL",
        dict(flow="coalesce(o_flow, CASE WHEN amount > 0 THEN 'income' WHEN o_category = 'Investment' THEN 'investment' ELSE 'expense' END)",
             category="coalesce(o_category, 'Uncategorised')", merchant="o_merchant", confidence="'high'", signal="'user.override'", layer="1"),
    ),
    "salary": (
        f"employer IS NOT NULL AND amount > 0 AND ({has('employer_alias')} OR {has('employer_alias_2')})",
        dict(flow="'income'", category="'Salary'", subcategory="employer", confidence=f"CASE WHEN {near('amount', 'salary', 0.05)} THEN 'high' ELSE 'med' END",
             signal="'profile.employer'", layer="2"),
    ),
    "card_payment": (
        f"last4 IS NOT NULL AND amount < 0 AND (contains(cleaned, 'card payment') OR {has('card_label')} OR regexp_matches(cleaned, '(?:x{{2,}}|\\*{{2,}}|·{{2,}}|x-|ending[ -]?)\\s*' || last4 || '\\b'))",
        dict(flow="'transfer'", category="'Transfer'", subcategory="'Credit card payment'", confidence="'high'", signal="'transfer.cc_payment'", layer="2", is_internal_transfer="true"),
    ),
    "rent": (
        f"rent IS NOT NULL AND amount < 0 AND ({has('landlord')} OR ({near('amount', 'rent', 0.02)} AND contains(cleaned, 'rent')))",
        dict(flow="'expense'", category="'Housing'", subcategory="'Rent'", confidence=f"CASE WHEN {has('landlord')} AND {near('amount', 'rent', 0.02)} THEN 'high' ELSE 'med' END",
             signal="'profile.home.rent'", layer="2"),
    ),
    "house_help": (
        f"amount < 0 AND ({has('cook')} OR {has('driver')} OR {has('driver_handle')})",
        dict(flow="'expense'", category="'Household'", subcategory=f"CASE WHEN {has('cook')} THEN 'cook' ELSE 'driver' END",
             confidence=f"CASE WHEN NOT {has('cook')} OR {near('amount', '2000000', 0.1)} THEN 'high' ELSE 'med' END", signal="'profile.house_help'", layer="2"),
    ),
    "loan_emi": (
        f"has_loans AND amount < 0 AND (regexp_matches(cleaned, '\\bemi\\b') OR contains(cleaned, 'home loan') OR contains(cleaned, 'auto loan') OR (NOT evidence AND ({EMI_HOME} OR {EMI_AUTO})))",
        dict(flow="'expense'", category="'Loan'", subcategory=f"CASE WHEN {EMI_HOME} THEN 'home EMI' ELSE 'auto EMI' END", confidence="'high'", signal="'profile.loan'", layer="2",
             tax_section=f"CASE WHEN {EMI_HOME} THEN '24b' END"),
    ),
    "broker": (
        f"amount < 0 AND ({has('broker')} OR {has('broker_id')} OR {has('platform')})",
        dict(flow="'investment'", category="'Investment'", subcategory=f"CASE WHEN {has('broker')} OR {has('broker_id')} THEN broker ELSE platform END", confidence="'high'",
             signal=f"'profile.broker.' || CASE WHEN {has('broker')} OR {has('broker_id')} THEN broker_id ELSE 'platform' END", layer="2",
             tax_section=f"CASE WHEN {has('broker')} OR {has('broker_id')} THEN '80C' END"),
    ),
    "insurer": (
        f"amount < 0 AND {has('insurer')}",
        dict(flow="'expense'", category="'Insurance'", subcategory="'health'", confidence="'high'", signal="'profile.insurer'", layer="2", tax_section="'80D'"),
    ),
    "alias": (
        "a IS NOT NULL",
        dict(flow="CASE WHEN amount > 0 THEN 'income' WHEN a.c LIKE 'investment.%' THEN 'investment' ELSE 'expense' END", category="a.d", subcategory="a.s", merchant="a.m",
             confidence="'high'", signal="CASE WHEN a.u = 'user' THEN 'user.merchant_alias' ELSE 'pack.merchants.' || a.s END", layer="4"),
    ),
    "keyword": (
        """(contains(cleaned, 'card payment') OR (regexp_matches(cleaned, '\\b(electricity|gas)\\b') AND amount < 0) OR (regexp_matches(cleaned, '\\b(interest|refund)\\b') AND amount > 0))""",
        dict(flow="CASE WHEN contains(cleaned, 'card payment') THEN 'transfer' WHEN amount < 0 THEN 'expense' ELSE 'income' END",
             category="CASE WHEN contains(cleaned, 'card payment') THEN 'Transfer' WHEN amount < 0 THEN 'Utilities' WHEN regexp_matches(cleaned, '\\binterest\\b') THEN 'Income' ELSE 'Refund' END",
             subcategory="CASE WHEN contains(cleaned, 'card payment') THEN 'Credit card payment' WHEN regexp_matches(cleaned, '\\belectricity\\b') THEN 'Electricity' WHEN amount < 0 THEN 'Gas' WHEN regexp_matches(cleaned, '\\binterest\\b') THEN 'Interest' END",
             confidence="CASE WHEN contains(cleaned, 'card payment') OR regexp_matches(cleaned, '\\belectricity\\b') THEN 'med' ELSE 'low' END",
             signal="CASE WHEN contains(cleaned, 'card payment') THEN 'keyword.card_payment' WHEN regexp_matches(cleaned, '\\belectricity\\b') THEN 'keyword.electricity' WHEN amount < 0 THEN 'keyword.gas' WHEN regexp_matches(cleaned, '\\binterest\\b') THEN 'keyword.interest' ELSE 'keyword.refund' END",
             layer="5", review_required="NOT (contains(cleaned, 'card payment') OR regexp_matches(cleaned, '\\belectricity\\b'))"),
    ),
    "recurrence": (
        "amount < 0 AND cadence IS NOT NULL",
        dict(flow="'expense'", category="'Subscriptions'", confidence="CASE WHEN occurrences >= 6 THEN 'high' ELSE 'med' END", signal="'recurrence.' || cadence", layer="6", is_recurring="true"),
    ),
    "fallback": (
        "true",
        dict(flow="CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END", category="'Uncategorised'", confidence="'low'", layer="7", review_required="true"),
    ),
}
SHOWN = ["flow", "category", "subcategory", "merchant", "confidence", "signal", "layer", "review_required", "is_internal_transfer", "is_recurring", "tax_section"]
DEFAULTS = {"review_required": "false", "is_internal_transfer": "false", "is_recurring": "false"}


def sql_columns(layers) -> str:
    out = []
    for column in SHOWN:
        arms = " ".join(f"WHEN {SQL_LAYERS[name][0]} THEN {SQL_LAYERS[name][1].get(column, DEFAULTS.get(column, 'NULL'))}" for name in layers)
        kind = {"layer": "INT", **{c: "BOOLEAN" for c in DEFAULTS}}.get(column, "VARCHAR")
        out.append(f"CAST(CASE {arms} END AS {kind}) AS {column}")
    return ", ".join(out)


def on_looked(select: str, *ctes: str) -> str:
    return b.with_ctes(b.SQL_LINES, SQL_PROFILES, SQL_ALIASES, SQL_OVERRIDES, SQL_RHYTHM, SQL_LOOKUPS, *ctes, select=select)


def looked_up(spark, sf_dir):
    rows = raw_rows(spark, sf_dir)
    return rules.attach_lookups(
        rows, profiles(spark, sf_dir), overrides(spark, sf_dir), aliases(spark, sf_dir), recur.recurrence_index(rows)
    )


def found_by(rows, verdict):
    """Rows with a verdict, which comes out of a generator: a filter on it would be pushed below and decide every row twice."""
    return rows.select("*", F.inline(F.array(F.struct(verdict.alias("verdict"))))).filter("verdict is not null")


def _layer(name, build):
    """A query of the rows one layer has a verdict for, evaluated on its own."""

    @query(f"layer_{name}", on_looked(f"SELECT txn_id, {sql_columns([name])} FROM looked WHERE {SQL_LAYERS[name][0]}"))
    def run(spark, sf_dir):
        return found_by(looked_up(spark, sf_dir), build()).select("txn_id", *[F.col(f"verdict.{c}").alias(c) for c in SHOWN])

    return run


_layer("override", lambda: rules.override_verdict())
_layer("salary", lambda: rules.salary_verdict(F.col("cleaned")))
_layer("card_payment", lambda: rules.card_payment_verdict(F.col("cleaned")))
_layer("rent", lambda: rules.rent_verdict(F.col("cleaned")))
_layer("house_help", lambda: rules.house_help_verdict(F.col("cleaned")))
_layer("loan_emi", lambda: rules.loan_verdict(F.col("cleaned"), F.col("evidence")))
_layer("broker", lambda: rules.broker_verdict(F.col("cleaned")))
_layer("insurer", lambda: rules.insurer_verdict(F.col("cleaned")))
_layer("alias", lambda: rules.alias_verdict())
_layer("keyword", lambda: rules.keyword_verdict(F.col("cleaned")))
_layer("recurrence", lambda: rules.recurrence_verdict())
_layer("fallback", lambda: rules.fallback_verdict())

PROFILE_LAYERS = ["salary", "card_payment", "rent", "house_help", "loan_emi", "broker", "insurer"]


@query(
    "profile_rules",
    on_looked(
        f"SELECT txn_id, {sql_columns(PROFILE_LAYERS)} FROM looked WHERE "
        + " OR ".join(f"({SQL_LAYERS[n][0]})" for n in PROFILE_LAYERS)
    ),
)
def profile_rules(spark, sf_dir):
    rows = found_by(looked_up(spark, sf_dir), rules.profile_verdict(F.col("cleaned"), F.col("evidence")))
    return rows.select("txn_id", *[F.col(f"verdict.{c}").alias(c) for c in SHOWN])


SQL_CLASSIFIED = f"""
decided AS (SELECT {', '.join(RAW)}, cleaned, has_projects, {sql_columns(list(SQL_LAYERS))} FROM looked),
projected AS (SELECT *, CASE WHEN flow <> 'expense' OR NOT has_projects THEN NULL
    WHEN txn_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND (contains(cleaned, 'blue') OR contains(cleaned, 'utilities')
      OR contains(lower(category), 'blue') OR contains(lower(category), 'utilities')) THEN 'p1'
    WHEN txn_date BETWEEN DATE '1997-06-01' AND DATE '1998-06-30' THEN 'p2' END AS project_id FROM decided),
classified AS (SELECT * REPLACE (CASE WHEN project_id IS NULL THEN signal ELSE 'project.one_time' END AS signal,
    CASE WHEN project_id IS NULL THEN layer ELSE 9 END AS layer, is_recurring AND project_id IS NULL AS is_recurring) FROM projected)"""


def classified(spark, sf_dir, rows=None):
    rows = raw_rows(spark, sf_dir) if rows is None else rows
    return rules.classify(
        rows, profiles(spark, sf_dir), overrides(spark, sf_dir), aliases(spark, sf_dir), recur.recurrence_index(rows)
    )


def shown(rows, *extra):
    return rows.select("txn_id", *[F.col(f"verdict.{c}").alias(c) for c in SHOWN], *extra)


@query("classify", on_looked(f"SELECT txn_id, {', '.join(SHOWN)}, project_id FROM classified", SQL_CLASSIFIED))
def classify(spark, sf_dir):
    return shown(classified(spark, sf_dir), F.col("verdict.project_id").alias("project_id"))


@query("project_window", on_looked("SELECT txn_id, project_id FROM classified WHERE project_id IS NOT NULL", SQL_CLASSIFIED))
def project_window(spark, sf_dir):
    rows = classified(spark, sf_dir).select("txn_id", F.col("verdict.project_id").alias("project_id"))
    return rows.filter("project_id is not null")


@query(
    "layer_histogram",
    on_looked("SELECT owner_id, layer, confidence, count(*)::BIGINT AS rows FROM classified GROUP BY ALL", SQL_CLASSIFIED),
)
def layer_histogram(spark, sf_dir):
    rows = classified(spark, sf_dir).select("owner_id", "verdict.layer", "verdict.confidence")
    return rows.groupBy("owner_id", "layer", "confidence").agg(F.count("*").alias("rows"))


@query("alias_longest", on_looked("SELECT cleaned, a.p AS pattern, a.m AS canonical_merchant, evidence FROM alias_hits"))
def alias_longest(spark, sf_dir):
    texts = raw_rows(spark, sf_dir).select(text.clean(F.col("raw_description")).alias("cleaned"))
    found = rules.longest_pattern(texts, aliases(spark, sf_dir))
    return found.select("cleaned", "rule.pattern", "rule.canonical_merchant", "evidence")


def providers(spark, sf_dir):
    """Institution rules: two name fragments per supplier nation."""
    s = b.table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit("sup-"), F.col("s_suppkey")).alias("institution_id"),
        F.col("s_name").alias("display_name"),
        F.array(F.substring(F.lower("s_name"), 1, 17), F.lower("s_name")).alias("patterns"),
        F.when(F.col("s_suppkey") % 2 == 0, "Utilities").otherwise("Fees & Charges").alias("category"),
        F.lit(None).cast("string").alias("subcategory"), F.when(F.col("s_suppkey") % 7 == 0, "expense").alias("flow"),
    )


@query(
    "provider_longest",
    on_looked(
        """SELECT cleaned, arg_min(institution_id, (-length(pattern), seq, no)) AS institution_id FROM (SELECT DISTINCT cleaned FROM raw)
        JOIN (SELECT s_suppkey AS seq, 'sup-' || s_suppkey AS institution_id, substr(lower(s_name), 1, 17) AS pattern, 0 AS no FROM supplier
              UNION ALL SELECT s_suppkey, 'sup-' || s_suppkey, lower(s_name), 1 FROM supplier) ON contains(cleaned, pattern) GROUP BY cleaned"""
    ),
)
def provider_longest(spark, sf_dir):
    texts = raw_rows(spark, sf_dir).select(text.clean(F.col("raw_description")).alias("cleaned"))
    found = rules.longest_pattern(texts, rules.provider_patterns(providers(spark, sf_dir)))
    return found.select("cleaned", "rule.institution_id")


@query(
    "layer_provider",
    on_looked(
        """SELECT txn_id, CASE WHEN s % 7 = 0 THEN 'expense' WHEN amount > 0 THEN 'income' ELSE 'expense' END AS flow,
        CASE WHEN s % 2 = 0 THEN 'Utilities' ELSE 'Fees & Charges' END AS category, 3::INT AS layer
        FROM (SELECT *, regexp_extract(cleaned, 'supplier#(\\d+)', 1)::BIGINT AS s FROM looked)"""
    ),
)
def layer_provider(spark, sf_dir):
    rows = raw_rows(spark, sf_dir)
    found = rules.attach_lookups(
        rows, profiles(spark, sf_dir), overrides(spark, sf_dir), aliases(spark, sf_dir), recur.recurrence_index(rows),
        providers(spark, sf_dir),
    )
    return found_by(found, rules.provider_verdict()).select("txn_id", "verdict.flow", "verdict.category", "verdict.layer")


# ------------------------------------------------------------------------ counterparties
def registry(spark, sf_dir):
    """Per owner: own VPAs, a broker by name and an outsider, in declared order."""
    o = F.col("owner_id")
    none = F.array().cast("array<string>")

    def entry(id, kind, own, vpa=none, names=none, last4=none):
        return F.struct(
            F.lit(id).alias("id"), F.lit(kind).alias("kind"), F.lit(own).alias("is_own_money"), vpa.alias("vpa_fragments"),
            names.alias("name_tokens"), last4.alias("last4"),
        )

    return owners(spark, sf_dir).select(
        "owner_id",
        F.array(
            entry("short", "family", True, names=F.array(F.lit("pa"), F.concat(F.lit("PAY9"), o % 10))),
            entry("own", "own_account", True, vpa=F.array(F.concat(F.lit("Pay1"), o % 10, F.lit("@")))),
            entry("out", "broker", False, names=F.array(F.concat(F.lit("pay"), o % 10))),
            entry("digits", "card_bill", True, last4=F.array(F.concat(o % 7, F.lit("@")))),
        ).alias("entries"),
    )


SQL_PARTIES = """
parties AS (SELECT txn_id, CASE
    WHEN contains(counterparty_raw, 'pay9' || (owner_id % 10)) THEN 'short'
    WHEN contains(counterparty_raw, 'pay1' || (owner_id % 10) || '@') THEN 'own'
    WHEN contains(counterparty_raw, 'pay' || (owner_id % 10)) THEN 'out'
    WHEN contains(counterparty_raw, (owner_id % 7) || '@') THEN 'digits' END AS counterparty_id FROM ledger_lines)"""


@query(
    "counterparty_first",
    b.with_ctes(
        b.SQL_LINES,
        SQL_PARTIES,
        select="""SELECT txn_id, counterparty_id, CASE counterparty_id WHEN 'own' THEN 'own_account' WHEN 'out' THEN 'external'
        WHEN 'short' THEN 'known_own' WHEN 'digits' THEN 'known_own' ELSE 'unknown' END AS counterparty_kind FROM parties""",
    ),
)
def counterparty_first(spark, sf_dir):
    rows = rules.resolve_counterparty(raw_rows(spark, sf_dir), registry(spark, sf_dir))
    return rows.select("txn_id", "counterparty_id", "counterparty_kind")


# --------------------------------------------------------------------- finalise, reruns
def decided_rows(spark, sf_dir, first_ingest=True, ledger=None):
    """Classified rows with a stand-in label-model decision and transfer result."""
    rows = classified(spark, sf_dir, ledger)
    key = F.col("amount")
    accepted = (key % 10 == 0) & F.col("verdict.review_required")
    final = F.when(
        accepted, F.col("verdict").withField("category", F.lit("Dining")).withField("review_required", F.lit(False))
        .withField("layer", F.lit(fv.LAYER_LABEL_MODEL)),
    ).otherwise(F.col("verdict"))
    return rows.withColumns(
        {
            "final": final,
            "source": F.when(accepted, "local_ml").otherwise("deterministic"),
            "prediction_id": F.when(accepted, F.concat(F.lit("pred_"), "txn_id")),
            "is_transfer": key % 13 == 0,
            "suspected": (key % 17 == 0) & (key > 0),
            "prev_category": F.lit(None).cast("string") if first_ingest else F.when(key % 26 == 0, "atm_cash"),
        }
    )


def sql_final(prev: str) -> str:
    return f"""
finals AS (SELECT *, flow = 'transfer' OR is_internal_transfer OR amount % 13 = 0 AS tr, amount % 10 = 0 AND review_required AS accepted,
  amount % 17 = 0 AND amount > 0 AS sus, {prev} AS prev FROM classified),
stored AS (SELECT owner_id, txn_id, txn_date, amount, raw_description, CASE WHEN tr THEN 'transfer' ELSE flow END AS flow,
  CASE WHEN tr THEN CASE WHEN category = 'cc_payment' THEN category WHEN prev IS NOT NULL THEN prev
    WHEN category IN ('self_transfer', 'cc_payment', 'atm_cash') THEN category ELSE 'Transfer' END
    WHEN accepted THEN 'Dining' ELSE category END AS category,
  subcategory, coalesce(merchant, subcategory) AS merchant, confidence, CASE WHEN accepted AND NOT tr THEN 10 ELSE layer END AS layer,
  NOT tr AND ((review_required AND NOT accepted) OR sus) AS review_required, tr AS is_internal_transfer,
  NOT tr AND sus AS suspected_transfer, CASE WHEN accepted AND NOT tr THEN 'local_ml' ELSE 'deterministic' END AS source,
  CASE WHEN accepted AND NOT tr THEN 'pred_' || txn_id END AS accepted_prediction_id, project_id, tax_section, fy_key
  FROM finals)"""


STORED = ["txn_id", "flow", "category", "subcategory", "merchant", "confidence", "layer", "review_required", "is_internal_transfer",
          "suspected_transfer", "source", "accepted_prediction_id", "project_id", "tax_section"]


@query("finalize", on_looked(f"SELECT {', '.join(STORED)} FROM stored", SQL_CLASSIFIED, sql_final("NULL")))
def finalize(spark, sf_dir):
    return rules.finalize(decided_rows(spark, sf_dir)).select(*STORED)


@query(
    "reclassify",
    on_looked(
        """SELECT s.txn_id, s.category, s.flow, s.merchant FROM stored s JOIN ledger_lines l USING (txn_id)
        WHERE s.category IS DISTINCT FROM l.category OR s.flow IS DISTINCT FROM l.flow OR s.merchant IS DISTINCT FROM l.merchant""",
        SQL_CLASSIFIED,
        sql_final("CASE WHEN amount % 26 = 0 THEN 'atm_cash' END"),
    ),
)
def reclassify(spark, sf_dir):
    # put together once: rhythms, classification and comparison read it
    ledger, _ = stored(b.ledger_lines(spark, sf_dir).select(*READ, "category", "flow", "merchant"), "ledger")
    rows = ledger.select(*READ, *[F.col(c).alias(f"old_{c}") for c in ("category", "flow", "merchant")])
    after = rules.finalize(decided_rows(spark, sf_dir, first_ingest=False, ledger=rows))
    return rules.changed_rows(ledger, after).select("txn_id", "category", "flow", "merchant")


def sql_normalized(column: str) -> str:
    known = sorted({c for group in fv.TAXONOMY.values() for c in group})
    key = f"lower(trim({column}))"
    leaf = f"replace(regexp_extract({key}, '[^.]*$'), '-', '_')"
    listed = ", ".join(f"'{k}'" for k in known)
    return (
        f"coalesce({b.sql_case(key, fv.LEGACY_CATEGORIES)}, CASE WHEN {key} IN ({listed}) THEN {key} END, "
        f"CASE WHEN {leaf} IN ({listed}) THEN {leaf} END, 'uncategorised')"
    )


SQL_LEGACY = f"""
legacy AS (SELECT txn_id, amount, CASE WHEN layer = 2 THEN 'expenses.' || lower(category) || '.food-delivery' WHEN layer = 5 THEN ' ' || upper(category) ELSE category END AS category FROM ledger_lines)"""


def legacy_rows(spark, sf_dir):
    category = (
        F.when(F.col("layer") == 2, F.concat(F.lit("expenses."), F.lower("category"), F.lit(".food-delivery")))
        .when(F.col("layer") == 5, F.concat(F.lit(" "), F.upper("category"))).otherwise(F.col("category"))
    )
    return b.ledger_lines(spark, sf_dir).select("txn_id", "amount", category.alias("category"))


@query(
    "category_backfill",
    b.with_ctes(
        b.SQL_LINES,
        SQL_LEGACY,
        select=f"SELECT txn_id, {sql_normalized('category')} AS category, {sql_normalized('category')} IS DISTINCT FROM category AS category_changed FROM legacy",
    ),
)
def category_backfill(spark, sf_dir):
    return rules.backfill_categories(legacy_rows(spark, sf_dir)).select("txn_id", "category", "category_changed")


@query(
    "flow_for_category",
    b.with_ctes(
        b.SQL_LINES,
        SQL_LEGACY,
        select=f"""SELECT txn_id, CASE
          {' '.join(f"WHEN replace(lower(category), ' ', '_') IN ({', '.join(repr(c) for c in cats)}) THEN '{flow}'" for flow, cats in fv.TAXONOMY.items())}
          WHEN category = 'Transfer' THEN 'transfer' WHEN amount > 0 THEN 'income' WHEN category = 'Investment' THEN 'investment' ELSE 'expense' END AS flow
        FROM legacy""",
    ),
)
def flow_for_category(spark, sf_dir):
    return legacy_rows(spark, sf_dir).select("txn_id", text.flow_for_category(F.col("category"), F.col("amount")).alias("flow"))


@query(
    "build_signals",
    b.with_ctes(
        SQL_PROFILES,
        select="""SELECT owner_id, employer, employer_alias AS first_alias, CASE WHEN employer IS NOT NULL THEN salary END::BIGINT AS salary, rent::BIGINT AS rent,
        CASE WHEN has_loans THEN 4050055 END::BIGINT AS second_emi, card_label,
        CASE WHEN platform IS NULL THEN 1 ELSE 2 END::INT AS brokers, CASE WHEN has_projects THEN 2 ELSE 0 END::INT AS projects FROM profiles""",
    ),
)
def build_signals(spark, sf_dir):
    p = profiles(spark, sf_dir)
    return p.select(
        "owner_id", F.col("employer.name").alias("employer"), F.lower(F.get(F.col("employer.aliases"), F.lit(0))).alias("first_alias"),
        F.col("employer.monthly_amount").alias("salary"), F.col("rent.monthly_rent").alias("rent"),
        F.get(F.col("loans"), F.lit(1))["emi_amount"].alias("second_emi"), F.get(F.col("cards"), F.lit(0))["label"].alias("card_label"),
        F.size("brokers").alias("brokers"), F.size("projects").alias("projects"),
    )


@query(
    "referenced_institutions",
    b.with_ctes(
        SQL_PROFILES,
        select="SELECT owner_id, broker_id AS institution_id FROM profiles UNION SELECT owner_id, 'platform' FROM profiles WHERE platform IS NOT NULL",
    ),
)
def referenced_institutions(spark, sf_dir):
    records = household_records(spark, sf_dir)
    return rules.referenced_institutions(records)


@query(
    "override_equi",
    on_looked("SELECT txn_id, o_merchant FROM looked WHERE rule_id IS NOT NULL"),
)
def override_equi(spark, sf_dir):
    return looked_up(spark, sf_dir).filter("override is not null").select("txn_id", F.col("override.merchant").alias("o_merchant"))


# ------------------------------------------------------------------------------ quality
@query(
    "golden_accuracy",
    on_looked(
        f"""SELECT c.layer, count(*)::BIGINT AS rows, count(*) FILTER (WHERE c.flow = l.flow)::BIGINT AS flow_ok,
        count(*) FILTER (WHERE {sql_normalized('c.category')} = {sql_normalized('l.category')})::BIGINT AS category_ok,
        count(*) FILTER (WHERE c.review_required = l.review_required)::BIGINT AS review_ok
        FROM classified c JOIN ledger_lines l USING (txn_id) GROUP BY ALL""",
        SQL_CLASSIFIED,
    ),
)
def golden_accuracy(spark, sf_dir):
    from ledgerloom.operators import quality

    expected = b.ledger_lines(spark, sf_dir).select("txn_id", "flow", "category", "review_required")
    return quality.accuracy_by_layer(classified(spark, sf_dir), expected)

"""The classification cascade: the first rule layer with a verdict wins, then project isolation.

Every layer is one nullable verdict struct and the cascade is a coalesce, so a ledger is
classified in a single projection after its lookups are joined:

* household profile: one row per owner with arrays in declared order, so "first match" is an
  array filter and a row never fans out;
* overrides and recurrence: equality on (owner_id, signature);
* merchant aliases: all patterns at once by a multi-pattern automaton, which reads the descriptions where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom import fixed_values as fv
from ledgerloom.functions import money, text
from ledgerloom.functions.vectors import let
from ledgerloom.operators.rollups import top_per
from ledgerloom.session import stored

PART_CHARS = 8_000_000  # of patterns in one automaton

VERDICT = (
    "flow string, category string, subcategory string, merchant string, confidence string, reason string, "
    "signal string, layer int, review_required boolean, is_internal_transfer boolean, is_recurring boolean, "
    "project_id string, tax_section string"
)
VERDICT_COLUMNS = [field.strip().split(" ")[0] for field in VERDICT.split(",")]

PROFILE_SCHEMA = (
    "owner_id bigint, "
    "employer struct<name:string,aliases:array<string>,monthly_amount:bigint>, "
    "rent struct<landlord_name:string,monthly_rent:bigint>, "
    "house_help array<struct<name:string,role:string,monthly_amount:bigint,upi_handle:string>>, "
    "loans array<struct<institution_id:string,kind:string,emi_amount:bigint>>, "
    "cards array<struct<institution_id:string,last4:string,label:string>>, "
    "brokers array<struct<institution_id:string,name:string,tax_section:string>>, "
    "insurers array<struct<institution_id:string,name:string,kind:string,tax_section:string>>, "
    "projects array<struct<id:string,name:string,start_date:date,end_date:date,category_hints:array<string>>>"
)


def verdict(condition: Column, **fields) -> Column:
    """A verdict struct where the condition holds, else null."""
    defaults = {"review_required": False, "is_internal_transfer": False, "is_recurring": False}
    values = {**defaults, **fields}
    columns = []
    for field in VERDICT.split(","):
        name, kind = field.strip().split(" ")
        value = values.get(name)
        columns.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name))
    return F.when(condition, F.struct(*columns))


def joined(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def first_hit(items: Column, test) -> Column:
    """First array element that passes, null if none does."""
    return F.get(F.filter(items, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(0))


def has(cleaned: Column, needle: Column) -> Column:
    return F.coalesce(F.contains(cleaned, F.lower(needle)) & (needle != ""), F.lit(False))


# ------------------------------------------------------------------- alias rules (layer 4)
def _automata(rules: DataFrame, part_chars: int) -> tuple[DataFrame, int]:
    """Distinct patterns in parts of bounded text, each an array in the order of preference: longest first, then by seq."""
    best = rules.filter(F.col("pattern") != "").groupBy("pattern").agg(F.min("seq").alias("seq"))
    total = best.agg(F.sum(F.length("pattern"))).first()[0] or 0
    parts = max(1, -(-total // part_chars))
    keyed = best.select(
        F.pmod(F.xxhash64("pattern"), F.lit(parts)).cast("int").alias("part"), F.struct((-F.length("pattern")).alias("size"), "seq", "pattern").alias("p")
    )
    lists = keyed.groupBy("part").agg(F.array_sort(F.collect_list("p")).alias("all"))
    return lists.select("part", F.col("all.pattern").alias("patterns")), parts


def _matcher() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The preferred pattern of each text. A list of patterns stands before the texts that it is for; one automaton is held at a time."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, patterns = None, []
        for batch in batches:
            texts, found = [], []
            for cleaned, listed in zip(batch.column("cleaned").to_pylist(), batch.column("patterns").to_pylist(), strict=True):
                if listed is not None:
                    automaton, patterns = ahocorasick.Automaton(), listed
                    for i, p in enumerate(listed):
                        automaton.add_word(p, i)
                    automaton.make_automaton()
                elif automaton is not None and cleaned is not None:
                    first = min((i for _, i in automaton.iter(cleaned)), default=None)
                    if first is not None:
                        texts.append(cleaned)
                        found.append(patterns[first])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(found, pa.string())], names=["cleaned", "pattern"])

    return match


def longest_pattern(descriptions: DataFrame, rules: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """For each distinct `cleaned` description, the longest rule pattern inside it.

    `rules`: pattern, seq (position; the earlier of equally long patterns wins) and any payload,
    returned as struct `rule`. `evidence` tells whether a pattern of at least five characters hit.

    Patterns are cut into parts of bounded text. Each task gets one part and a share of the distinct texts, builds the part's automaton
    and passes over each of its texts once; neither the driver nor a task ever holds the whole rule table.
    """
    lists, parts = _automata(rules, part_chars)
    shares = int(descriptions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a test for null here would be pushed down to the scan, with a second run of the expressions behind `cleaned`
    asked = descriptions.select("cleaned").distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("cleaned"), F.lit(shares)).cast("int").alias("share"),
        F.lit(1).alias("kind"), "cleaned", F.lit(None).cast("array<string>").alias("patterns"),
    )
    told = lists.select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("cleaned"), "patterns"
    )
    # one (part, share) a partition, where hashing them would leave some partitions empty; the sort puts each list before its texts
    place = (F.col("part") * shares + F.col("share")).cast("int")
    dealt = told.unionByName(asked).repartitionById(parts * shares, place).sortWithinPartitions("kind")
    hits = dealt.select("cleaned", "patterns").mapInArrow(_matcher(), "cleaned string, pattern string")
    named = rules.filter(F.col("pattern") != "").groupBy("pattern").agg(F.min_by(F.struct(*rules.columns), "seq").alias("rule"))
    size = F.length("pattern")
    narrow = hits.join(named.select("pattern", F.col("rule.seq").alias("seq")), "pattern")
    best = narrow.groupBy("cleaned").agg(F.min(F.struct((-size).alias("size"), "seq", "pattern")).alias("best"))
    return best.select("cleaned", F.col("best.pattern").alias("pattern"), (-F.col("best.size") >= fv.MIN_ALIAS_EVIDENCE_CHARS).alias("evidence")).join(
        named, "pattern"
    ).select("cleaned", "rule", "evidence")


def provider_patterns(rules: DataFrame) -> DataFrame:
    """Explodes provider rules (patterns array) to one pattern per row for `longest_pattern`."""
    return rules.select("*", F.posexplode("patterns").alias("pattern_no", "pattern")).withColumn(
        "seq", F.struct("seq", "pattern_no")
    ).drop("patterns", "pattern_no")


# ------------------------------------------------------------------------ verdict layers
def override_verdict() -> Column:
    """Layer 1, over joined column `override` (struct of a user's rule)."""
    o = F.col("override")
    by_sign = F.when(F.col("amount") > 0, "income").when(o["category"] == "Investment", "investment").otherwise("expense")
    return verdict(
        o.isNotNull(),
        flow=F.coalesce(o["flow"], by_sign),
        category=F.coalesce(o["category"], F.lit("Uncategorised")),
        subcategory=o["subcategory"],
        merchant=o["merchant"],
        confidence="high",
        reason=F.concat_ws(": ", F.lit("your rule for this description"), o["note"]),
        signal="user.override",
        layer=fv.LAYER_OVERRIDE,
        tax_section=o["tax_section"],
    )


def salary_verdict(cleaned: Column) -> Column:
    e, amount = F.col("profile.employer"), F.col("amount")
    named = F.exists(e["aliases"], lambda a: has(cleaned, a))
    steady = e["monthly_amount"].isNull() | money.near(amount, e["monthly_amount"], 0.05)
    return verdict(
        (amount > 0) & named,
        flow="income", category="Salary", subcategory=e["name"],
        confidence=F.when(steady, "high").otherwise("med"),
        reason=joined("salary credit from employer ", e["name"]),
        signal="profile.employer", layer=fv.LAYER_PROFILE,
    )


def card_payment_verdict(cleaned: Column) -> Column:
    cards = F.col("profile.cards")
    phrase = reduce(lambda a, b: a | b, [cleaned.contains(p) for p in fv.CARD_PAYMENT_PHRASES])

    def names_card(card: Column) -> Column:
        masked = F.concat(F.lit("(?i)" + fv.MASKED_LAST4_PREFIX_PATTERN), card["last4"], F.lit("(?![0-9A-Za-z_])"))
        by_last4 = F.coalesce((card["last4"] != "") & F.rlike(cleaned, masked), F.lit(False))
        return phrase | has(cleaned, card["label"]) | by_last4

    return let(
        F.when(F.col("amount") < 0, first_hit(cards, names_card)),
        lambda card: verdict(
            card.isNotNull(),
            flow="transfer", category="Transfer", subcategory="Credit card payment", confidence="high",
            reason=joined("payment of own card ", F.coalesce(card["label"], F.lit("on file"))),
            signal="transfer.cc_payment", layer=fv.LAYER_PROFILE, is_internal_transfer=True,
        ),
    )


def rent_verdict(cleaned: Column) -> Column:
    r, amount = F.col("profile.rent"), F.col("amount")
    landlord = has(cleaned, r["landlord_name"])
    right_size = money.near(amount, r["monthly_rent"], 0.02)
    return verdict(
        r.isNotNull() & (amount < 0) & (landlord | (right_size & cleaned.contains("rent"))),
        flow="expense", category="Housing", subcategory="Rent",
        confidence=F.when(landlord & right_size, "high").otherwise("med"),
        reason=F.concat_ws(" to ", F.lit("rent on file"), r["landlord_name"]),
        signal="profile.home.rent", layer=fv.LAYER_PROFILE,
    )


def house_help_verdict(cleaned: Column) -> Column:
    amount = F.col("amount")
    hit = first_hit(F.col("profile.house_help"), lambda x: has(cleaned, x["name"]) | has(cleaned, x["upi_handle"]))

    def stamp(h: Column) -> Column:
        usual = h["monthly_amount"].isNull() | money.near(amount, h["monthly_amount"], 0.1)
        return verdict(
            h.isNotNull(),
            flow="expense", category="Household", subcategory=h["role"],
            confidence=F.when(usual, "high").otherwise("med"),
            reason=joined("payment to house help ", h["name"]), signal="profile.house_help", layer=fv.LAYER_PROFILE,
        )

    return let(F.when(amount < 0, hit), stamp)


def loan_verdict(cleaned: Column, evidence: Column) -> Column:
    """An amount coincidence counts only when no known merchant is named in the text."""
    amount = F.col("amount")
    emi_word = text.matches(cleaned, r"\bemi\b")

    def right_size(loan: Column) -> Column:
        return F.coalesce(money.near(amount, loan["emi_amount"], 0.02), F.lit(False)) & ~evidence

    hit = first_hit(
        F.col("profile.loans"),
        lambda x: right_size(x) | emi_word | F.contains(cleaned, F.lower(F.concat(x["kind"], F.lit(" loan")))),
    )
    return let(
        F.when(amount < 0, hit),
        lambda loan: verdict(
            loan.isNotNull(),
            flow="expense", category="Loan", subcategory=joined(loan["kind"], " EMI"),
            confidence=F.when(right_size(loan), "high").otherwise("med"),
            reason=joined("instalment of the ", loan["kind"], " loan on file"), signal="profile.loan", layer=fv.LAYER_PROFILE,
            tax_section=F.when(loan["kind"] == "home", "24b"),
        ),
    )


def broker_verdict(cleaned: Column) -> Column:
    hit = first_hit(F.col("profile.brokers"), lambda x: has(cleaned, x["name"]) | has(cleaned, x["institution_id"]))
    return let(
        F.when(F.col("amount") < 0, hit),
        lambda b: verdict(
            b.isNotNull(),
            flow="investment", category="Investment", subcategory=b["name"], confidence="high",
            reason=joined("contribution to broker ", b["name"]), signal=joined("profile.broker.", b["institution_id"]),
            layer=fv.LAYER_PROFILE, tax_section=b["tax_section"],
        ),
    )


def insurer_verdict(cleaned: Column) -> Column:
    return let(
        F.when(F.col("amount") < 0, first_hit(F.col("profile.insurers"), lambda x: has(cleaned, x["name"]))),
        lambda i: verdict(
            i.isNotNull(),
            flow="expense", category="Insurance", subcategory=i["kind"], confidence="high",
            reason=joined(i["kind"], " premium to ", i["name"]), signal="profile.insurer", layer=fv.LAYER_PROFILE,
            tax_section=i["tax_section"],
        ),
    )


def profile_verdict(cleaned: Column, evidence: Column) -> Column:
    """Layer 2: salary, own card, rent, house help, loan, broker, insurer, in that order."""
    return F.coalesce(
        salary_verdict(cleaned), card_payment_verdict(cleaned), rent_verdict(cleaned), house_help_verdict(cleaned),
        loan_verdict(cleaned, evidence), broker_verdict(cleaned), insurer_verdict(cleaned),
    )


def provider_verdict() -> Column:
    """Layer 3, over joined column `provider` (rule of the longest institution pattern)."""
    p = F.col("provider")
    return verdict(
        p.isNotNull(),
        flow=F.coalesce(p["flow"], F.when(F.col("amount") > 0, "income").otherwise("expense")),
        category=p["category"], subcategory=p["subcategory"], confidence="high",
        reason=joined("institution rule ", p["display_name"]), signal="pack.institutions", layer=fv.LAYER_PROVIDER,
    )


def alias_verdict() -> Column:
    """Layer 4, over joined column `alias` (rule of the longest merchant pattern)."""
    a = F.col("alias")
    invests = F.get(F.split(F.coalesce(a["category"], F.lit("")), r"\."), F.lit(0)) == "investment"
    own = a["source"] == "user"
    leaf = F.coalesce(a["subcategory"], a["category"], F.lit("merchant"))
    return verdict(
        a.isNotNull(),
        flow=F.when(F.col("amount") > 0, "income").when(invests, "investment").otherwise("expense"),
        category=text.display_category(a["category"], a["subcategory"]),
        subcategory=a["subcategory"], merchant=a["canonical_merchant"], confidence=a["confidence"],
        reason=joined("description names ", a["canonical_merchant"], F.when(own, " (your alias)").otherwise(" (pack alias)")),
        signal=F.when(own, "user.merchant_alias").otherwise(F.concat(F.lit("pack.merchants."), leaf)),
        layer=fv.LAYER_ALIAS,
    )


def keyword_verdict(cleaned: Column, rules=None) -> Column:
    """Layer 5: the card-bill rail, then the first keyword whose flow fits the sign."""
    amount = F.col("amount")
    rail = verdict(
        (amount < 0) & text.matches(F.coalesce("raw_description", F.lit("")), fv.CARD_BILL_RAIL_PATTERN, True),
        flow="transfer", category="cc_payment", subcategory="Credit card payment", confidence="high",
        reason="card-bill payment rail", signal="keyword.cred_billdesk_cc_payment", layer=fv.LAYER_KEYWORD,
        is_internal_transfer=True,
    )
    table = fv.KEYWORD_RULES if rules is None else rules
    fields = "struct<keyword:string,category:string,subcategory:string,flow:string,confidence:string>"
    entries = F.array(*[F.struct(*[F.lit(v) for v in (k, c, sub, f, conf or "low")]).cast(fields) for k, c, sub, f, conf in table])
    number = None
    for i, (keyword, _, _, flow, _) in enumerate(table):
        fits = money.flow_fits_sign(amount, F.lit(flow), True) if flow else F.lit(True)
        hit = text.keyword_match(cleaned, keyword) & fits
        number = F.when(hit, i) if number is None else number.when(hit, i)
    # the rule is found once; its fields are read from the literal table
    named = let(
        F.get(entries, number),
        lambda rule: verdict(
            rule.isNotNull(),
            flow=F.coalesce(rule["flow"], F.when(amount > 0, "income").otherwise("expense")),
            category=rule["category"], subcategory=rule["subcategory"], confidence=rule["confidence"],
            reason=joined("keyword '", rule["keyword"], "'"),
            signal=joined("keyword.", F.regexp_replace(rule["keyword"], " +", "_")),
            layer=fv.LAYER_KEYWORD, review_required=rule["confidence"] == "low",
        ),
    )
    return F.coalesce(rail, named)


def recurrence_verdict() -> Column:
    """Layer 6, over joined columns `cadence` and `occurrences` of the row's signature."""
    named = F.coalesce("merchant_hint", F.trim("raw_description"))
    return verdict(
        (F.col("amount") < 0) & F.col("cadence").isNotNull(),
        flow="expense", category="Subscriptions", subcategory=F.col("merchant_hint"),
        confidence=F.when(F.col("occurrences") >= fv.STRONG_RECURRENCES, "high").otherwise("med"),
        reason=joined(named, " recurs ", F.col("cadence")), signal=joined("recurrence.", F.col("cadence")),
        layer=fv.LAYER_RECURRENCE, is_recurring=True,
    )


def fallback_verdict() -> Column:
    """Layer 7."""
    return verdict(
        F.lit(True),
        flow=F.when(F.col("amount") > 0, "income").otherwise("expense"),
        category="Uncategorised", confidence="low", reason="no rule matched", layer=fv.LAYER_FALLBACK,
        review_required=True,
    )


def isolate_project(found: Column, cleaned: Column) -> Column:
    """Expense verdicts inside a declared project's dates and hints are re-stamped."""

    def applies(project: Column) -> Column:
        hints = F.coalesce(project["category_hints"], F.array().cast("array<string>"))
        hinted = F.exists(hints, lambda h: F.contains(cleaned, F.lower(h)) | F.contains(F.lower(found["category"]), F.lower(h)))
        return F.col("txn_date").between(project["start_date"], project["end_date"]) & ((F.size(hints) == 0) | hinted)

    def stamp(project: Column) -> Column:
        stamped = F.struct(
            *[
                {
                    "reason": joined("one-time project ", project["name"]),
                    "signal": F.lit("project.one_time"),
                    "layer": F.lit(fv.LAYER_PROJECT),
                    "project_id": project["id"],
                    "is_recurring": F.lit(False),
                }.get(name, found[name]).alias(name)
                for name in VERDICT_COLUMNS
            ]
        )
        return F.when(project.isNotNull(), stamped).otherwise(found)

    return let(F.when(found["flow"] == "expense", first_hit(F.col("profile.projects"), applies)), stamp)


# --------------------------------------------------------------------------- the cascade
def _rule_finder(folder: str, kind: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The preferred rule of each text, of a list that a task reads from the shared folder, where it stands in the order of preference."""

    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bare = folder.removeprefix("file:")
        system, path = fs.FileSystem.from_uri(bare) if "://" in bare else (fs.LocalFileSystem(), "/" + bare.lstrip("/"))
        files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        listed = pa.concat_tables([pq.read_table(f, filesystem=system) for f in files])
        rules = listed.column("rule").combine_chunks().cast(kind)
        automaton = ahocorasick.Automaton()
        for i, pattern in enumerate(listed.column("pattern").to_pylist()):
            automaton.add_word(pattern, i)
        automaton.make_automaton()
        for batch in batches:
            texts = batch.to_pylist() if len(rules) else [None] * len(batch)
            first = [None if t is None else min((i for _, i in automaton.iter(t)), default=None) for t in texts]
            yield rules.take(pa.array(first, pa.int64()))

    return match


def with_longest_pattern(rows: DataFrame, rules: DataFrame, name: str, part_chars: int = PART_CHARS) -> DataFrame:
    """`rows` (with `cleaned`) plus `name`: the rule of the longest pattern inside `cleaned`, as `longest_pattern` finds it, else null.

    Rules whose patterns fit one automaton lie in the shared folder: tasks read them there and pass over their rows, which are
    not shuffled. Larger rule tables go by `longest_pattern`, over distinct texts.
    """
    patterns = rules.filter(F.col("pattern") != "").groupBy("pattern").agg(F.min_by(F.struct(*rules.columns), "seq").alias("rule"))
    if (patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0) > part_chars:
        found = longest_pattern(rows, rules, part_chars).select("cleaned", F.col("rule").alias(name))
        return rows.join(found, "cleaned", "left")
    # one file, so that its rows keep the order of preference
    ranked = patterns.repartition(1).sortWithinPartitions(-F.length("pattern"), "rule.seq", "pattern")
    kept, folder = stored(ranked, "patterns")
    kind = kept.schema["rule"].dataType
    match = _rule_finder(folder, to_arrow_type(kind))
    # not deterministic for the optimizer: it would match once for a filter on the verdict and again for its columns
    return rows.withColumn(name, F.arrow_udf(match, kind).asNondeterministic()("cleaned"))


def attach_lookups(
    ledger: DataFrame,
    profiles: DataFrame,
    overrides: DataFrame,
    aliases: DataFrame,
    recurrence: DataFrame,
    providers: DataFrame | None = None,
) -> DataFrame:
    """Joins everything the layers read; the number of rows does not change.

    `merchant_hint` is a merchant the parser extracted, when the ledger has that column.
    """
    rows = ledger if "merchant_hint" in ledger.columns else ledger.withColumn("merchant_hint", F.lit(None).cast("string"))
    rows = rows.withColumn("signature", text.signature(F.coalesce("raw_description", F.lit(""))))

    first_rule = top_per(overrides.filter("match_signature <> ''"), ["owner_id", "match_signature"], [F.col("seq")], 1)
    rule = first_rule.select(
        "owner_id", F.col("match_signature").alias("signature"),
        F.struct("flow", "category", "subcategory", "merchant", "tax_section", "note").alias("override"),
    )
    # narrow rows are shuffled: what is wide (the household) or made of the text (cleaned, the rules found) comes last
    if "merchant_hint" in ledger.columns:
        recurring_key = F.when(F.col("merchant_hint").isNull(), F.col("signature")).otherwise(text.signature(F.col("merchant_hint")))
        rhythm = recurrence.withColumnRenamed("signature", "recurring_signature")
        rows = rows.join(rule, ["owner_id", "signature"], "left").withColumn("recurring_signature", recurring_key)
        rows = rows.join(rhythm, ["owner_id", "recurring_signature"], "left")
    else:  # both are looked up by the same signature, so the rows are shuffled once for them
        known, _ = stored(rule.join(recurrence, ["owner_id", "signature"], "full_outer"), "known-signatures")
        rows = rows.join(known, ["owner_id", "signature"], "left").withColumn("recurring_signature", F.col("signature"))
    household, _ = stored(profiles.select("owner_id", F.struct(*[c for c in profiles.columns if c != "owner_id"]).alias("profile")), "households")
    rows = rows.join(household, "owner_id", "left")
    # out of a generator, so that a filter on a verdict is not pushed below and cleans the text again for every word it asks for
    cleaned = F.struct(text.clean(F.coalesce("raw_description", F.lit(""))).alias("cleaned"))
    rows = rows.select("*", F.inline(F.array(cleaned)))
    rows = with_longest_pattern(rows, aliases, "alias")
    evidence = F.coalesce(F.length("alias.pattern") >= fv.MIN_ALIAS_EVIDENCE_CHARS, F.lit(False))
    rows = rows.withColumn("evidence", evidence)
    return rows if providers is None else with_longest_pattern(rows, provider_patterns(providers), "provider")


def decide(rows: DataFrame) -> DataFrame:
    """Adds the `verdict` struct to rows prepared by `attach_lookups`."""
    cleaned = F.col("cleaned")
    layers = [override_verdict(), profile_verdict(cleaned, F.col("evidence"))]
    if "provider" in rows.columns:
        layers.append(provider_verdict())
    layers += [alias_verdict(), keyword_verdict(cleaned), recurrence_verdict(), fallback_verdict()]
    found = rows.withColumn("verdict", F.coalesce(*layers))
    return found.withColumn("verdict", isolate_project(F.col("verdict"), cleaned))


def classify(
    ledger: DataFrame,
    profiles: DataFrame,
    overrides: DataFrame,
    aliases: DataFrame,
    recurrence: DataFrame,
    providers: DataFrame | None = None,
) -> DataFrame:
    """The ledger with a `verdict` struct per row."""
    decided = decide(attach_lookups(ledger, profiles, overrides, aliases, recurrence, providers))
    kept = [c for c in ledger.columns if c != "merchant_hint"]
    return decided.select(*kept, "verdict")


# ------------------------------------------------------------------------- counterparties
def resolve_counterparty(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds counterparty_id and counterparty_kind from the owner's registry, first entry wins.

    `registry`: owner_id, entries array<struct<id, kind, is_own_money, vpa_fragments,
    name_tokens, last4>> in declared order.
    """
    raw = F.col("counterparty_raw")
    lowered = F.lower(raw)
    none = F.array().cast("array<string>")

    def matches(entry: Column) -> Column:
        return (
            F.exists(F.coalesce(entry["vpa_fragments"], none), lambda f: F.contains(lowered, F.lower(f)))
            | F.exists(F.coalesce(entry["name_tokens"], none), lambda t: (F.length(t) >= 3) & F.contains(lowered, F.lower(t)))
            | F.exists(F.coalesce(entry["last4"], none), lambda d: F.contains(lowered, d))
        )

    hit = F.col("_hit")
    kind = (
        F.when(hit.isNull(), "unknown").when(~hit["is_own_money"], "external")
        .when(hit["kind"] == "own_account", "own_account").otherwise("known_own")
    )
    found = rows.join(registry, "owner_id", "left").withColumn("_hit", F.when(raw != "", first_hit(F.col("entries"), matches)))
    return found.withColumns({"counterparty_id": hit["id"], "counterparty_kind": kind}).drop("entries", "_hit")


# ------------------------------------------------------------------- profile and finalise
def build_signals(profiles: DataFrame) -> DataFrame:
    """Declared household records (major units) to the classifier's signals (minor units)."""

    def minor(value: Column) -> Column:
        return money.js_round(value.cast("double") * fv.MINOR_PER_MAJOR)

    e, home = F.col("employer"), F.col("home")
    aliases = F.when(F.size(e["aliases"]) > 0, e["aliases"]).otherwise(F.array(e["name"]))
    employer = F.when(
        e.isNotNull(),
        F.struct(e["name"].alias("name"), aliases.alias("aliases"), minor(e["monthly_net_salary"]).alias("monthly_amount")),
    )
    rent = F.when(
        home["monthly_rent"].isNotNull(),
        F.struct(home["landlord_name"].alias("landlord_name"), minor(home["monthly_rent"]).alias("monthly_rent")),
    )
    house_help = F.transform(
        "house_help",
        lambda h: F.struct(h["name"].alias("name"), h["role"].alias("role"), minor(h["monthly_amount"]).alias("monthly_amount"), h["upi_handle"].alias("upi_handle")),
    )
    loans = F.transform(
        "loans",
        lambda l: F.struct(l["institution_id"].alias("institution_id"), l["kind"].alias("kind"), minor(l["emi_amount"]).alias("emi_amount")),
    )
    cards = F.transform(
        "cards",
        lambda c: F.struct(
            c["institution_id"].alias("institution_id"), c["last4"].alias("last4"),
            F.coalesce(c["nickname"], F.concat(F.lit("··"), c["last4"])).alias("label"),
        ),
    )
    projects = F.filter("projects", lambda p: p["start_date"].isNotNull() & p["end_date"].isNotNull())
    return profiles.select(
        "owner_id", employer.alias("employer"), rent.alias("rent"), house_help.alias("house_help"), loans.alias("loans"),
        cards.alias("cards"), F.concat("brokers", "investment_platforms").alias("brokers"), "insurers",
        projects.alias("projects"),
    )


def referenced_institutions(profiles: DataFrame) -> DataFrame:
    """Distinct institution ids a household's declared lists mention: (owner_id, institution_id)."""
    lists = [c for c in ("banks", "cards", "brokers", "investment_platforms", "insurers", "loans") if c in profiles.columns]
    ids = F.flatten(F.array(*[F.transform(c, lambda x: x["institution_id"].cast("string")) for c in lists]))
    return profiles.select("owner_id", F.explode(F.array_distinct(ids)).alias("institution_id")).filter("institution_id is not null")


def finalize(rows: DataFrame) -> DataFrame:
    """Stored ledger columns from `verdict`, the label model's `decision` and the transfer result.

    `rows` carry verdict (deterministic), final (verdict after the label model), source,
    prediction_id, is_transfer, suspected and prev_category (null on first ingest).
    """
    transfer = F.col("is_transfer") | F.coalesce("final.is_internal_transfer", F.lit(False)) | (F.col("final.flow") == "transfer")
    rows = rows.withColumn("_transfer", transfer)
    chosen = {name: F.when(F.col("_transfer"), F.col(f"verdict.{name}")).otherwise(F.col(f"final.{name}")) for name in VERDICT_COLUMNS}
    suspected = ~F.col("_transfer") & F.col("suspected")
    stored = text.transfer_storage_category(chosen["category"], F.col("prev_category"))
    return rows.withColumns(
        {
            "flow": F.when(F.col("_transfer"), "transfer").otherwise(chosen["flow"]),
            "category": F.when(F.col("_transfer"), stored).otherwise(chosen["category"]),
            "subcategory": chosen["subcategory"],
            "merchant": F.coalesce(chosen["merchant"], chosen["subcategory"]),
            "confidence": chosen["confidence"],
            "reason": chosen["reason"],
            "signal": chosen["signal"],
            "layer": chosen["layer"],
            "review_required": ~F.col("_transfer") & (chosen["review_required"] | suspected),
            "is_internal_transfer": F.col("_transfer"),
            "is_recurring": F.coalesce(chosen["is_recurring"], F.lit(False)),
            "project_id": chosen["project_id"],
            "tax_section": chosen["tax_section"],
            "suspected_transfer": suspected,
            "source": F.when(F.col("_transfer"), "deterministic").otherwise(F.col("source")),
            "accepted_prediction_id": F.when(~F.col("_transfer") & (F.col("source") == "local_ml"), F.col("prediction_id")),
        }
    ).drop("_transfer", "verdict", "final", "is_transfer", "suspected", "prev_category", "prediction_id")


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose category, flow or merchant differs after a rerun.

    Where `after` carries old_category, old_flow and old_merchant of the rows of `before` that it was made of, they are
    compared in place, and only rows whose key (owner_id, txn_id) comes several times meet all rows of that key.
    """
    keys, names = ["owner_id", "txn_id"], ("category", "flow", "merchant")
    old = before.select(*keys, *[F.col(c).alias(f"old_{c}") for c in names])
    if all(f"old_{c}" in after.columns for c in names):
        own = F.struct(*[f"old_{c}" for c in names])
        key = F.xxhash64(*keys)
        again, _ = stored(old.groupBy(key.alias("_key")).agg(F.count("*").alias("_rows")).filter("_rows > 1").select("_key"), "repeated-keys")
        told = old.withColumn("_key", key).join(again, "_key", "left_semi").groupBy(*keys).agg(F.collect_list(own).alias("_told"))
        # written, so that the join knows how few they are
        told, _ = stored(told, "repeated-rows")
        rows = after.filter("owner_id is not null and txn_id is not null").join(told, keys, "left")
        kept = [c for c in after.columns if c not in [f"old_{n}" for n in names]]
        both = rows.select(*kept, F.inline(F.coalesce("_told", F.array(own))))
    else:
        both = after.join(old, keys)
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in names]
    return both.filter(~(same[0] & same[1] & same[2]))


def backfill_categories(ledger: DataFrame) -> DataFrame:
    """Folds stored categories onto canonical keys and marks the rows that changed."""
    canonical = text.normalize_category(F.col("category"))
    return ledger.withColumns(
        {"category": canonical, "category_changed": ~canonical.eqNullSafe(F.col("category"))}
    )

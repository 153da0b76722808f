"""Internal transfers: one-to-one pairing of debit and credit legs, and single-sided evidence.

Pairing rule: debits in order each take the first unused credit of the same amount, at most a
few days away, not from the same document, where either both legs carry an explicit transfer
signal or both are bare (no merchant) and sit in two different own accounts. The order is
(txn_date, document_id, own_account_id, explicit, bare, txn_id).

How it runs on Spark:
* legs that agree on everything the rule looks at form a run; runs are counted, not collected;
* runs of one (owner, amount) split wherever more than the window passes without a leg, and each
  piece is paired on its own, run against run;
* a piece with too many runs is cut into ordered blocks. A pair of blocks depends only on the
  block to its left and the one above, so blocks on one diagonal are paired at the same time;
* run matches become leg matches by position, joined on equality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions import text
from ledgerloom.operators.ranking import GROUP_BOUND, rank_in_group, rank_sliced
from ledgerloom.session import checkpointed, stored_by

AMOUNT = ["owner_id", "abs_amount"]
RUN = ["day", "doc_key", "account_key", "explicit", "bare"]
MAX_RUNS = 50_000
SLOT_CHUNK = 4_096


# ------------------------------------------------------------------------- predicates
def own_name_hit(description: Column, own_names: Column) -> Column:
    lowered = F.lower(description)
    return F.exists(own_names, lambda n: (F.length(n) >= 3) & F.contains(lowered, F.lower(n)))


def with_flags(rows: DataFrame, own_names: Column | None = None) -> DataFrame:
    """Adds the predicates every later step uses; null descriptions count as empty."""
    described = F.coalesce("raw_description", F.lit(""))
    names = F.coalesce(own_names if own_names is not None else F.array().cast("array<string>"), F.array().cast("array<string>"))
    own_party = F.coalesce(F.col("counterparty_kind").isin(fv.OWN_COUNTERPARTY_KINDS), F.lit(False))
    autopay = text.matches(described, fv.CARD_AUTOPAY_PATTERN, True)
    explicit = (
        F.coalesce(F.col("flow") == "transfer", F.lit(False)) | own_party
        | text.matches(described, fv.TRANSFER_PATTERN, True) | autopay | own_name_hit(described, names)
    )
    card_bill = (
        text.matches(described, fv.CARD_BILL_PATTERN, True) | autopay
        | text.matches(described, fv.CARD_BILL_RAIL_PATTERN, True)
    )
    has_merchant = F.coalesce("merchant", F.lit("")) != ""
    account = F.coalesce("own_account_id", F.lit(""))
    return rows.withColumns(
        {
            "explicit": explicit,
            "candidate": explicit | (account != ""),
            "card_bill": card_bill,
            "payment_received": text.matches(described, fv.PAYMENT_RECEIVED_PATTERN, True),
            "own_party": own_party,
            "doc_key": F.coalesce("document_id", F.lit("")),
            "account_key": account,
            "bare": (account != "") & ~has_merchant,
            "abs_amount": F.abs("amount"),
            "day": F.unix_date("txn_date"),
            "side": F.when(F.col("amount") < 0, "debit").when(F.col("amount") > 0, "credit"),
        }
    )


# ---------------------------------------------------------------------------- pairing
def _next_open(link: list[int], at: int) -> int:
    root = at
    while link[root] != root:
        root = link[root]
    while link[at] != root:
        link[at], at = root, link[at]
    return root


def pair_runs(debits: list[tuple], credits: list[tuple], window_days: int) -> list[tuple[int, int, int, int, int]]:
    """(debit, credit, debit offset, credit offset, count) for two ordered lists of runs.

    A run is (day, doc, account, explicit, bare, rows).
    """
    left = [run[5] for run in credits]
    lists = {
        "explicit": [i for i, run in enumerate(credits) if run[3]],
        "bare": [i for i, run in enumerate(credits) if run[4]],
    }
    # skip links over used-up credits, one chain per kind; expired ones fall behind the heads
    chain = {kind: list(range(len(members) + 1)) for kind, members in lists.items()}
    head = {"explicit": 0, "bare": 0}
    out = []
    for d, (day, doc, account, explicit, bare, need) in enumerate(debits):
        taken = 0
        kinds = [k for k, on in (("explicit", explicit), ("bare", bare)) if on]
        at = {}
        for kind in kinds:
            members = lists[kind]
            while head[kind] < len(members) and credits[members[head[kind]]][0] < day - window_days:
                head[kind] += 1
            at[kind] = _next_open(chain[kind], head[kind])
        while taken < need:
            ahead = [(lists[k][at[k]], k) for k in kinds if at[k] < len(lists[k])]
            if not ahead:
                break
            c, kind = min(ahead)
            c_day, c_doc, c_account = credits[c][:3]
            if c_day > day + window_days:
                break
            other_account = kind == "explicit" or account != c_account
            if left[c] and other_account and not (doc and doc == c_doc):
                count = min(need - taken, left[c])
                out.append((d, c, taken, credits[c][5] - left[c], count))
                taken += count
                left[c] -= count
            if not left[c]:
                chain[kind][at[kind]] = at[kind] + 1
            at[kind] = _next_open(chain[kind], at[kind] + 1)
    return out


MATCH_SCHEMA = (
    "owner_id bigint, abs_amount bigint, "
    "d_day int, d_doc_key string, d_account_key string, d_explicit boolean, d_bare boolean, d_from bigint, "
    "c_day int, c_doc_key string, c_account_key string, c_explicit boolean, c_bare boolean, c_from bigint, "
    "matched bigint"
)
MATCH_COLUMNS = [field.strip().split(" ")[0] for field in MATCH_SCHEMA.split(",")]


def _piece_matches(key: tuple, debits: list[tuple], credits: list[tuple], window_days: int) -> list[tuple]:
    """Match rows of one piece; runs carry their already used count as a seventh field."""
    found = pair_runs([r[:6] for r in debits], [r[:6] for r in credits], window_days)
    return [
        (*key[:2], *debits[d][:5], debits[d][6] + d_from, *credits[c][:5], credits[c][6] + c_from, count)
        for d, c, d_from, c_from, count in found
    ]


def _matcher(keys: list[str], window_days: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs the pieces of a partition sorted by keys, side and run, one piece in memory at a time."""

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sides = None, {"debit": [], "credit": []}
        for batch in batches:
            rows = []
            columns = [batch[c].tolist() for c in (*RUN, "rows", "used")]
            for key, side, run in zip(zip(*[batch[k].tolist() for k in keys]), batch["side"].tolist(), zip(*columns)):
                if key != current:
                    if current is not None:
                        rows += _piece_matches(current, sides["debit"], sides["credit"], window_days)
                    current, sides = key, {"debit": [], "credit": []}
                sides[side].append(run)
            yield pd.DataFrame(rows, columns=MATCH_COLUMNS)
        if current is not None:
            yield pd.DataFrame(_piece_matches(current, sides["debit"], sides["credit"], window_days), columns=MATCH_COLUMNS)

    return match


def _match_pieces(runs: DataFrame, keys: list[str], window_days: int) -> DataFrame:
    together = runs.repartition(*keys).sortWithinPartitions(*keys, "side", *RUN)
    return together.mapInPandas(_matcher(keys, window_days), MATCH_SCHEMA)


def _with_pieces(runs: DataFrame, window_days: int) -> DataFrame:
    """Numbers the independent pieces of each amount and counts the runs in them."""
    days = runs.groupBy(*AMOUNT, "day").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("side") == "debit").alias("debits"),
        F.count_if(F.col("side") == "credit").alias("credits"),
    )
    by_day = Window.partitionBy(*AMOUNT).orderBy("day")
    starts = F.coalesce(F.col("day") - F.lag("day").over(by_day) > window_days, F.lit(False))
    days = days.withColumn("starts", starts.cast("int")).withColumn("piece", F.sum("starts").over(by_day))
    whole = Window.partitionBy(*AMOUNT, "piece")
    days = days.withColumns({f"piece_{c}": F.sum(c).over(whole) for c in ("runs", "debits", "credits")})
    two_sided = days.filter("piece_debits > 0 and piece_credits > 0").select(*AMOUNT, "day", "piece", "piece_runs")
    return runs.join(two_sided, [*AMOUNT, "day"])


def _meetings(extent: DataFrame, window_days: int) -> DataFrame:
    """Pairs of a debit and a credit block of one piece that lie within the window, with the round they meet in.

    A block meets its partners in order, one a round, and the partners of a block are consecutive because
    both sides are ordered by day.
    """
    piece = [*AMOUNT, "piece"]

    def side(name: str, prefix: str) -> DataFrame:
        named = [F.col(c).alias(f"{prefix}_{c}") for c in ("block", "first_day", "last_day")]
        return extent.filter(F.col("side") == name).select(*piece, *named)

    near = (F.col("d_first_day") - window_days <= F.col("c_last_day")) & (F.col("c_first_day") - window_days <= F.col("d_last_day"))
    return side("debit", "d").join(side("credit", "c"), piece).filter(near).select(
        *piece, "d_block", "c_block", (F.col("d_block") + F.col("c_block")).alias("wave")
    )


def _pair_large(runs: DataFrame, window_days: int, block_runs: int) -> DataFrame | None:
    """Run matches of oversized pieces, block against block along diagonals.

    Only blocks within the window of each other meet. A round reads the blocks whose first meeting it is and those
    carried over from the round before, so a block is written once for each of its partners, whatever the piece's length.
    """
    if runs.isEmpty():
        return None
    piece = [*AMOUNT, "piece"]
    ranked = rank_sliced(runs, [*piece, "side"], RUN, "place")
    blocks = checkpointed(ranked.withColumn("block", F.floor(F.col("place") / block_runs)).drop("place"))
    extent = blocks.groupBy(*piece, "side", "block").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    meetings = checkpointed(_meetings(extent, window_days))
    ends = F.array(
        F.struct(F.lit("debit").alias("side"), F.col("d_block").alias("block")),
        F.struct(F.lit("credit").alias("side"), F.col("c_block").alias("block")),
    )
    spans = meetings.select(*piece, "wave", F.inline(ends)).groupBy(*piece, "side", "block").agg(
        F.min("wave").alias("first_wave"), F.max("wave").alias("last_wave")
    )
    waiting = stored_by(blocks.join(spans, [*piece, "side", "block"]), "first_wave")
    # one number per round: bounded by the blocks of the longest piece
    waves = sorted(row[0] for row in meetings.select("wave").distinct().collect())
    found = carried = None
    for wave in waves:
        fresh = waiting.filter(F.col("first_wave") == wave)
        met = fresh if carried is None else fresh.unionByName(carried)
        # debit block i meets credit block wave - i
        meeting = F.when(F.col("side") == "debit", F.col("block")).otherwise(F.lit(wave) - F.col("block"))
        open_runs = met.filter("rows > 0").withColumn("meeting", meeting)
        matches = checkpointed(_match_pieces(open_runs, [*piece, "meeting"], window_days))
        used = _used_by(matches, "d", "debit").unionByName(_used_by(matches, "c", "credit"))
        carried = checkpointed(
            met.filter(F.col("last_wave") > wave).join(used, [*AMOUNT, "side", *RUN], "left")
            .withColumns(
                {
                    "rows": F.col("rows") - F.coalesce("taken", F.lit(0)),
                    "used": F.col("used") + F.coalesce("taken", F.lit(0)),
                }
            ).drop("taken")
        )
        found = matches if found is None else found.unionByName(matches)
    return found


def _used_by(matches: DataFrame, prefix: str, side: str) -> DataFrame:
    run = [F.col(f"{prefix}_{c}").alias(c) for c in RUN]
    return matches.groupBy(*AMOUNT, *run).agg(F.sum("matched").alias("taken")).withColumn("side", F.lit(side))


def match_runs(runs: DataFrame, window_days: int = fv.TRANSFER_WINDOW_DAYS, max_runs: int = MAX_RUNS) -> DataFrame:
    pieces = _with_pieces(runs, window_days).withColumn("used", F.lit(0).cast("bigint"))
    small = pieces.filter(F.col("piece_runs") <= max_runs).drop("piece_runs")
    matched = _match_pieces(small, [*AMOUNT, "piece"], window_days)
    large = _pair_large(pieces.filter(F.col("piece_runs") > max_runs).drop("piece_runs"), window_days, max_runs)
    return matched if large is None else matched.unionByName(large)


def transfer_pairs(
    flagged: DataFrame,
    window_days: int = fv.TRANSFER_WINDOW_DAYS,
    max_runs: int = MAX_RUNS,
    group_bound: int = GROUP_BOUND,
) -> DataFrame:
    """owner_id, debit_txn_id, credit_txn_id for rows prepared by `with_flags`."""
    legs = flagged.filter((F.col("explicit") | F.col("bare")) & F.col("side").isNotNull() & F.col("day").isNotNull()).select(
        *AMOUNT, "side", *RUN, "txn_id"
    )
    # read by the piece, size and pairing steps: written once instead of recomputed
    runs = checkpointed(legs.groupBy(*AMOUNT, "side", *RUN).agg(F.count("*").alias("rows")))
    matches = checkpointed(match_runs(runs, window_days, max_runs))

    # one row per matched pair: cut each match into chunks, spread them, then number the slots
    chunks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("matched") - 1, F.lit(SLOT_CHUNK).cast("bigint")))
    slots = matches.withColumn("chunk", chunks).repartition(*AMOUNT, "d_day", "d_doc_key", "d_from", "chunk")
    last = F.least(F.col("chunk") + SLOT_CHUNK, F.col("matched")) - 1
    slots = slots.withColumn("slot", F.explode(F.sequence("chunk", last)))
    run_key = [*AMOUNT, "side", *RUN]
    large = runs.filter(F.col("rows") > group_bound)
    placed = rank_in_group(legs, run_key, ["txn_id"], "place", large)

    def side(name: str, prefix: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{prefix}_{c}") for c in RUN]
        return placed.filter(F.col("side") == name).select(
            *AMOUNT, *renamed, F.col("place").alias(f"{prefix}_place"), F.col("txn_id").alias(f"{name}_txn_id")
        )

    debit_key = [*AMOUNT, *[f"d_{c}" for c in RUN], "d_place"]
    credit_key = [*AMOUNT, *[f"c_{c}" for c in RUN], "c_place"]
    pairs = slots.withColumns({"d_place": F.col("d_from") + F.col("slot"), "c_place": F.col("c_from") + F.col("slot")})
    return (
        pairs.join(side("debit", "d"), debit_key).join(side("credit", "c"), credit_key)
        .select("owner_id", "debit_txn_id", "credit_txn_id")
    )


# ----------------------------------------------------------------------------- results
def link_transfers(
    rows: DataFrame,
    own_names: Column | None = None,
    window_days: int = fv.TRANSFER_WINDOW_DAYS,
    max_runs: int = MAX_RUNS,
) -> DataFrame:
    """Every input row with is_transfer, suspected, and the id and kind of the link it is part of."""
    flagged = with_flags(rows, own_names)
    pairs = transfer_pairs(flagged, window_days, max_runs)
    ends = pairs.select(
        "owner_id",
        F.inline(
            F.array(
                F.struct(F.col("debit_txn_id").alias("txn_id"), F.col("credit_txn_id").alias("other_txn_id")),
                F.struct(F.col("credit_txn_id").alias("txn_id"), F.col("debit_txn_id").alias("other_txn_id")),
            )
        ),
    )
    linked = flagged.join(ends, ["owner_id", "txn_id"], "left")
    single_sided = F.col("candidate") & (
        ((F.col("side") == "debit") & F.col("card_bill")) | ((F.col("side") == "credit") & F.col("payment_received"))
    )
    is_transfer = F.col("other_txn_id").isNotNull() | F.coalesce(single_sided, F.lit(False)) | F.col("own_party")
    unresolved = F.coalesce("counterparty_kind", F.lit("unknown")) == "unknown"
    round_credit = (F.col("amount") >= fv.ROUND_TRANSFER_MIN_MINOR) & (F.col("amount") % fv.ROUND_TRANSFER_STEP_MINOR == 0)
    no_merchant = F.coalesce("merchant", F.lit("")) == ""
    return linked.withColumn("is_transfer", is_transfer).withColumn(
        "suspected", ~F.col("is_transfer") & round_credit & no_merchant & unresolved
    )


def links_of(linked: DataFrame) -> DataFrame:
    """The link table: one row per pair, card-bill payments told apart from account transfers."""
    pair = ["owner_id", "debit_txn_id", "credit_txn_id"]
    ends = linked.filter(F.col("other_txn_id").isNotNull()).select(
        "owner_id",
        F.when(F.col("side") == "debit", F.col("txn_id")).otherwise(F.col("other_txn_id")).alias("debit_txn_id"),
        F.when(F.col("side") == "debit", F.col("other_txn_id")).otherwise(F.col("txn_id")).alias("credit_txn_id"),
        "card_bill",
    )
    kinds = ends.groupBy(*pair).agg(F.bool_or("card_bill").alias("card_bill"))
    return kinds.select(
        text.shortened(F.concat_ws("_", F.lit("lnk"), "debit_txn_id", "credit_txn_id"), 80).alias("link_id"),
        *pair, F.when(F.col("card_bill"), "cc_payment").otherwise("account_transfer").alias("kind"),
        F.lit("high").alias("confidence"),
    )


def relink(linked: DataFrame) -> DataFrame:
    """Ledger rows after an additive relink: newly found transfers are stamped, none is un-marked.

    `linked` is the whole stored ledger through `link_transfers`.
    """
    newly = F.col("is_transfer") & ~F.col("is_internal_transfer")
    newly_suspected = F.col("suspected") & ~F.col("suspected_transfer") & ~F.col("is_internal_transfer")
    return linked.withColumns(
        {
            "flow": F.when(newly, "transfer").otherwise(F.col("flow")),
            "category": F.when(newly, "Transfer").otherwise(F.col("category")),
            "suspected_transfer": F.when(newly, F.lit(False)).when(newly_suspected, F.lit(True)).otherwise(F.col("suspected_transfer")),
            "review_required": F.when(newly, F.lit(False)).when(newly_suspected, F.lit(True)).otherwise(F.col("review_required")),
            "reason": F.when(newly, "internal transfer: paired with its opposite leg in a ledger-wide relink").otherwise(F.col("reason")),
            "newly_linked": newly,
            "newly_suspected": newly_suspected,
            "is_internal_transfer": F.col("is_internal_transfer") | newly,
        }
    )

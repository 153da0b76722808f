"""Text columns: every function maps Columns to a Column and stays inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.vectors import let

# Java's \b and \s follow Unicode word/space rules that differ from the patterns' intended
# ASCII boundary and full Unicode blank set, so both are spelled out.
_WORD_START, _WORD_END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_WORD_EDGE = rf"(?:(?<=[0-9A-Za-z_]){_WORD_END}|{_WORD_START}(?=[0-9A-Za-z_]))"
BLANKS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _edge(match: re.Match) -> str:
    """The cheap one-sided test where the neighbour is a word character, else the full one."""
    before, after = match.string[: match.start()], match.string[match.end() :]
    if re.match(r"(\((\?:)?)?(\w|\\d)", after):
        return _WORD_START
    if re.search(r"\w\)?$", before) and not re.search(r"\\[a-zA-Z]$", before):
        return _WORD_END
    return _WORD_EDGE


def pattern(regex: str, ignore_case: bool = False) -> str:
    """A fixed pattern with ASCII word edges and Unicode blanks, ready for rlike / regexp_*."""
    spelled = re.sub(r"\\b", _edge, regex, flags=re.ASCII).replace(r"\s", BLANKS)
    return ("(?i)" if ignore_case else "") + spelled


def matches(text: Column, regex: str, ignore_case: bool = False) -> Column:
    return text.rlike(pattern(regex, ignore_case))


def clean(text: Column) -> Column:
    """Lower case, blank runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), BLANKS + "+", " "))


def signature(text: Column) -> Column:
    """The merchant-like words of a description: no digits, references, punctuation or rail words."""
    lowered = F.lower(text)
    # a masked run without an x holds nothing that the next step keeps; the look-ahead skips positions that cannot start a run
    masked = F.regexp_replace(lowered, "(?=[0-9x*·]{4})" + pattern(fv.MASKED_RUN_PATTERN), " ")
    words = F.regexp_replace(F.when(lowered.contains("x"), masked).otherwise(lowered), "[^a-z]+", " ")
    return F.trim(F.regexp_replace(words, "(?<![a-z])(?:" + "|".join(fv.RAIL_WORDS) + ")(?: |$)", ""))


def quote_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def contains(text: Column, needle: Column, cleaned: bool = False) -> Column:
    """`cleaned` says that the text is clean already, so that several questions about it clean it once."""
    return F.contains(text if cleaned else clean(text), F.lower(needle))


def contains_any(text: Column, needles: Column, cleaned: bool = False) -> Column:
    """`needles` is an array column; null needles never match."""
    return let(text if cleaned else clean(text), lambda c: F.exists(needles, lambda n: F.coalesce(F.contains(c, F.lower(n)), F.lit(False))))


def contains_word(text: Column, needle: Column, cleaned: bool = False) -> Column:
    return F.rlike(text if cleaned else clean(text), F.concat(F.lit(_WORD_EDGE), quote_regex(F.lower(needle)), F.lit(_WORD_EDGE)))


def keyword_match(cleaned: Column, keyword: str) -> Column:
    """Single alphanumeric keywords match as whole words, phrases and handles as substrings."""
    if keyword.isalnum() and keyword.isascii():
        return matches(cleaned, rf"\b{keyword}\b")
    return cleaned.contains(keyword)


def title_case(text: Column) -> Column:
    """Upper-cases the first letter of each ASCII word and leaves the rest alone."""
    pieces = F.regexp_extract_all(text, F.lit(r"([0-9A-Za-z_]+|[^0-9A-Za-z_]+)"), F.lit(1))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))),
        "",
    )


def slug(text: Column, limit: int | None = None) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return made if limit is None else F.substring(made, 1, limit)


def split_taxonomy(dotted: Column) -> Column:
    """struct(category, subcategory): everything before the last dot, and what follows it."""
    parts = F.split(dotted, r"\.")
    count = F.size(parts)
    head = F.array_join(F.slice(parts, 1, F.greatest(count - 1, F.lit(1))), ".")
    tail = F.when(count > 1, F.element_at(parts, -1))
    return F.struct(F.nullif(head, F.lit("")).alias("category"), tail.alias("subcategory"))


def display_category(dotted: Column, subcategory: Column) -> Column:
    """First segment that is not a generic domain, title-cased."""
    kept = F.filter(
        F.split(F.coalesce(dotted, F.lit("")), r"\."),
        lambda s: (s != "") & ~s.isin(fv.TAXONOMY_DOMAINS),
    )
    chosen = F.coalesce(F.get(kept, F.lit(0)), subcategory, dotted, F.lit("Uncategorised"))
    return title_case(F.trim(F.regexp_replace(chosen, "[._-]+", " ")))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalize_category(category: Column) -> Column:
    """Legacy spellings to canonical keys, then the dotted leaf, then 'uncategorised'."""
    known = sorted({c for group in fv.TAXONOMY.values() for c in group})
    key = F.lower(F.trim(category))
    leaf = F.replace(F.element_at(F.split(key, r"\."), -1), F.lit("-"), F.lit("_"))
    return F.coalesce(
        literal_map(fv.LEGACY_CATEGORIES)[key],
        F.when(key.isin(known), key),
        F.when(leaf.isin(known), leaf),
        F.lit("uncategorised"),
    )


def category_label(key: Column) -> Column:
    words = F.filter(F.split(key, "_"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    is_display = ~key.contains("_") & key.rlike("^[A-Z]")
    return F.coalesce(literal_map(fv.CATEGORY_LABELS)[key], F.when(is_display, key), titled)


def flow_of_canonical(category: Column) -> Column:
    """Flow that owns a canonical category key, else null."""
    key = F.regexp_replace(F.lower(category), " ", "_")
    owner = {c: flow for flow, cats in reversed(list(fv.TAXONOMY.items())) for c in cats}
    return literal_map(owner)[key]


def flow_for_category(category: Column, amount: Column) -> Column:
    return F.coalesce(
        flow_of_canonical(category),
        F.when(category == "Transfer", "transfer")
        .when(amount > 0, "income")
        .when(category == "Investment", "investment")
        .otherwise("expense"),
    )


def transfer_storage_category(category: Column, existing: Column) -> Column:
    keys = fv.TAXONOMY["transfer"]
    return (
        F.when(category == "cc_payment", category)
        .when((existing == "Transfer") | existing.isin(keys), existing)
        .when(category.isin(keys), category)
        .otherwise("Transfer")
    )


def clean_label(raw: Column) -> Column:
    """A readable name for an unknown recurring descriptor, at most 36 characters."""
    blanks = f"[[^!-~]&&{BLANKS}]+"  # most characters are told apart by one test

    def shortened_label(label: Column) -> Column:
        label_text = F.coalesce(F.nullif(label, F.lit("")), F.trim(F.regexp_replace(raw, blanks, " ")))
        return let(label_text, lambda t: F.when(F.length(t) <= fv.LABEL_CHARS, t).otherwise(at_word(F.substring(t, 1, fv.LABEL_CHARS))))

    def at_word(head: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(F.regexp_replace(head, fv.LABEL_CUT_WORD_PATTERN, "")), F.lit("")), head)

    # a position is tested for its first character before it is for the one behind; both edges of a run of word
    # characters need one side only
    code, number = (p.removeprefix(r"\b").removesuffix(r"\b") for p in (fv.LABEL_CODE_PATTERN, fv.LABEL_NUMBER_PATTERN))
    made = F.regexp_replace(raw, fv.LABEL_TIME_PATTERN, "")
    for regex in (
        f"(?i){fv.LABEL_REF_GROUP_PATTERN}",
        "(?i)(?=r)" + pattern(fv.LABEL_REF_PATTERN),
        f"(?i){_WORD_START}{code}{_WORD_END}",
        f"(?=[0-9]{{3}}){_WORD_START}{number}{_WORD_END}",
        fv.LABEL_SIGN_PATTERN,
        "(?i)(?=[abcinpruv])" + pattern(fv.LABEL_RAIL_PATTERN),
        blanks,
    ):
        made = F.regexp_replace(made, regex, " ")
    return let(F.trim(F.regexp_replace(made, f"(?i){fv.LABEL_TAIL_PATTERN}", "")), shortened_label)


def merchant_tokens(text: Column) -> Column:
    return F.array_distinct(
        F.filter(F.split(signature(text), " "), lambda t: (F.length(t) >= 3) & ~t.isin(fv.TOKEN_STOPWORDS))
    )


def proper_token_prefixes(sig: Column) -> Column:
    """All leading token runs of a signature except the whole of it."""
    tokens = F.split(sig, " ")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))),
        lambda n: F.when(n < F.size(tokens), F.array_join(F.slice(tokens, 1, n), " ")),
    )


def is_token_prefix(a: Column, b: Column) -> Column:
    """Either signature is a proper token prefix of the other."""
    a_in_b = F.startswith(b, F.concat(a, F.lit(" ")))
    b_in_a = F.startswith(a, F.concat(b, F.lit(" ")))
    return (a != "") & (b != "") & (a_in_b | b_in_a)


def grams(text: Column, width: int = fv.MIN_ALIAS_CHARS) -> Column:
    """Distinct character windows, used to turn substring joins into equality joins."""
    last = F.length(text) - width + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(width))))


def stable_id(limit: int, *parts) -> Column:
    """Deterministic identifier: parts joined by '_', unsafe characters replaced, shortened where over `limit`."""
    joined = F.concat_ws("_", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return shortened(F.regexp_replace(joined, "[^a-zA-Z0-9_-]", "_"), limit, joined)


def shortened(made: Column, limit: int, whole: Column | None = None) -> Column:
    """`made` if it fits, else its beginning and 16 digits of a digest of the whole text, so that different texts stay apart."""

    def fit(m: Column) -> Column:
        digest = F.substring(F.sha2(m if whole is None else whole, 256), 1, 16)
        return F.when(F.length(m) <= limit, m).otherwise(F.concat(F.substring(m, 1, limit - 17), F.lit("_"), digest))

    return let(made, fit)

"""Quality rules by distribution divergence, in DataFrame functions alone.

Each document gets counts (words, symbols, repeated lines, words in repeated three-word windows) and two histograms: of
character classes and of the common words of its language. Both are compared with the language's reference by the
Jensen-Shannon distance (square root of the divergence to base 2, so 0 to 1). References are fixed and come from no
corpus, so what is judged can't move them: a corpus of junk is rejected, and a document has the same verdict in any
company. Others can be passed, as ``fitted`` makes them from documents that are known to be good. Short documents have
noisy histograms: a distance counts only from a minimum length on.

Defined results: a null text counts as empty and fails the base rule; a null or unlisted language has a reference for
character classes only, which leaves characters of no class out (they may be any script's letters) and is not compared
with a text that these make up more than half of; repeated rows are judged alike; extra columns stay in ``keep_clean``
and are left out of ``judge``; an empty table gives an empty table.

Scale: one narrow pass that writes the counts, and one over these; no text is shuffled and nothing is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The usual function words of each language, lower case.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "by", "on", "are"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "para"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
}
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Character classes, each with the sign that stands for it; letters a-z are the rest.
CLASSES = {"space": (SPACES, " "), "symbol": (SYMBOLS, "#"), "digit": ("0123456789", "0"), "punctuation": (".,;:!?'\"()-", "."), "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")}
LOWER = "abcdefghijklmnopqrstuvwxyz"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected beyond these distances, from these lengths on. The limit for words is a fraction of the distance
#: that a text without any common word has to the reference.
MAX_CLASS_DISTANCE, MIN_CLASS_CHARS = 0.30, 200
WORD_FRACTION, MIN_WORD_COUNT = 0.9, 100
#: A reference is fitted on this many words at least.
MIN_FITTED_WORDS = 10_000

#: Fixed values, rounded estimates of ordinary prose: how many of a thousand words are each of ``COMMON_WORDS``.
WORD_SHARES = {
    "de": (33, 33, 28, 18, 13, 11, 11, 10, 9, 7, 8, 7, 7, 8, 8, 8),
    "en": (60, 31, 28, 26, 22, 20, 11, 11, 9, 9, 8, 8, 7, 6, 7, 5),
    "es": (62, 38, 30, 31, 27, 26, 20, 17, 12, 13, 11, 11, 11, 10, 9, 8),
    "fr": (45, 28, 24, 22, 20, 16, 15, 13, 11, 11, 10, 9, 9, 8, 8, 7),
}
#: Fixed values likewise: how many of a thousand characters are of each of ``CLASSES``, of no class, and a-z.
CLASS_SHARES = {
    "de": (150, 1, 10, 33, 60, 20, 726),
    "en": (175, 1, 10, 33, 30, 3, 748),
    "es": (170, 1, 10, 33, 25, 25, 736),
    "fr": (168, 1, 10, 42, 28, 35, 716),
    "": (165, 1, 10, 35, 35, 20, 734),
}
#: (class shares, common-word shares) by language, "" being any other.
Reference = tuple[list[float], list[float]]

N_HITS = max(map(len, COMMON_WORDS.values()))
N_CLASSES, WIDE = len(CLASSES) + 2, len(CLASSES)


def words_of(text: Column) -> Column:
    """The words (runs of other than ASCII white space) of a text; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def _signs(text: Column) -> Column:
    """The text with each character's class for it: a-z go, the classes' characters become signs, others stay."""
    chars = "".join(c for c, _ in CLASSES.values())
    signs = "".join(sign * len(c) for c, sign in CLASSES.values())
    return F.translate(F.coalesce(text, F.lit("")), chars + LOWER, signs)


def _listed(lang: Column) -> Column:
    """The common words of a language; null without a list."""
    out = F.lit(None).cast("array<string>")
    for name, listed in sorted(COMMON_WORDS.items()):
        out = F.when(lang == name, F.array(*map(F.lit, listed))).otherwise(out)
    return out


def _count(text: Column, part: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, part))) / F.octet_length(part)


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with a struct ``__vg_q`` of the counts and histograms of each text.

    The columns are made in steps, since each step reads the one before many times. The struct comes out of an explode of
    one element: a filter on it stays above, and so does not repeat the expressions of every step.
    """
    text_col, lang_col = f"`{text_col}`", f"`{lang_col}`"
    text, w, g, s = F.coalesce(F.col(text_col), F.lit("")), F.col("__vg_w"), F.col("__vg_g"), F.col("__vg_s")
    lang = F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise("")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    every = sorted({x for listed in COMMON_WORDS.values() for x in listed})
    df = docs.withColumns({"__vg_w": words_of(F.col(text_col)), "__vg_l": lines, "__vg_t": _signs(F.col(text_col)), "__vg_c": _listed(lang)})
    df = df.withColumns(
        {
            "__vg_g": F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
            "__vg_h": F.concat(F.lit(" "), F.array_join(F.filter(w, lambda x: x.isin(every)), "  "), F.lit(" ")),
        }
    )
    # only a text with a window that occurs twice is sorted; sorted, equal windows are neighbours
    df = df.withColumn("__vg_s", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))))
    twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["g"] == x["g"]) | (F.get(s, i - 1)["g"] == x["g"]))
    df = df.withColumn("__vg_p", F.sort_array(F.transform(twice, lambda x: x["p"])))
    # the start of each such window adds the words up to the next such start, at most three
    p = F.col("__vg_p")
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long"))
    t, size, counts = F.col("__vg_t"), F.length(text), {}
    for name, (_, sign) in CLASSES.items():
        counts[name] = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(sign)))
    signs = sum(list(counts.values())[1:], counts["space"])
    wide = F.length(t) - signs
    classes = F.array(*[c.cast("double") for c in (*counts.values(), wide, size - F.length(t))])
    q = F.struct(
        F.size(w).cast("long").alias("n_words"),
        (size - counts["space"]).cast("long").alias("word_chars"),
        counts["symbol"].cast("long").alias("n_symbols"),
        (F.size("__vg_l") - F.size(F.array_distinct("__vg_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        lang.alias("lang"),
        classes.alias("classes"),
        F.array(*[F.coalesce(_count(F.col("__vg_h"), F.concat(F.lit(" "), F.get(F.col("__vg_c"), F.lit(i)), F.lit(" "))), F.lit(0.0)) for i in range(N_HITS)]).alias("hits"),
    )
    return df.withColumn("__vg_q", q).withColumn("__vg_q", F.explode(F.array("__vg_q"))).drop("__vg_w", "__vg_l", "__vg_t", "__vg_c", "__vg_g", "__vg_h", "__vg_s", "__vg_p")


def _shares(counts: Sequence[float], total: float) -> list[float]:
    return [c / total if total else 0.0 for c in counts]


def references() -> dict[str, Reference]:
    """The fixed references."""
    return {name: (_shares(own, sum(own)), _shares(WORD_SHARES.get(name, ()), 1000)) for name, own in CLASS_SHARES.items()}


def fitted(good: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, Reference]:
    """References from documents that are known to be good, other than those to be judged: sums over all of them (one row
    a language meets on the driver). A language with fewer than ``MIN_FITTED_WORDS`` words keeps the fixed one."""
    q = F.col("__vg_q")
    sums = [F.sum(F.get(q[c], F.lit(i))).alias(f"{c}{i}") for c, n in (("classes", N_CLASSES), ("hits", N_HITS)) for i in range(n)]
    out = references()
    for r in measured(good, text_col, lang_col).groupBy(q["lang"].alias("lang")).agg(*sums, F.sum(q["n_words"]).alias("n")).collect():
        if r["n"] >= MIN_FITTED_WORDS:
            classes = [r[f"classes{i}"] for i in range(N_CLASSES)]
            out[r["lang"]] = (_shares(classes, sum(classes)), _shares([r[f"hits{i}"] for i in range(len(COMMON_WORDS.get(r["lang"], ())))], r["n"]))
    return out


def js_distance(counts: list[Column], total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance between counts that sum to ``total`` and reference shares; 0 for an empty total."""

    def part(p: Column, q: float) -> Column:
        m = (p + F.lit(q)) / 2
        own = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
        return own + (F.lit(q) * F.log2(F.lit(q) / m) if q > 0 else F.lit(0.0))

    parts = [part(c / total, q) for c, q in zip(counts, reference, strict=True)]
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), sum(parts[1:], parts[0]) / 2))).otherwise(F.lit(0.0))


def word_limit(hits: Sequence[float]) -> float:
    """The word distance beyond which a document is rejected, from the shares of a reference's common words."""
    share = sum(hits)
    # the common words have no part in such a text: each gives its share to the divergence, all other words the rest
    rest = max(0.0, 1 - share)
    m = (1 + rest) / 2
    divergence = (share - math.log2(m) + (rest * math.log2(rest / m) if rest else 0.0)) / 2
    return WORD_FRACTION * math.sqrt(max(0.0, divergence))


def verdict(refs: dict[str, Reference]) -> tuple[Column, Column, Column, Column]:
    """base_failed, class distance, word distance (null where the guard holds) and kept, for ``measured`` rows."""
    f = F.col("__vg_q")
    n, all_chars = f["n_words"], F.aggregate(f["classes"], F.lit(0.0), lambda a, x: a + x)
    class_d, word_d, limit = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    for name, (classes, hits) in sorted(refs.items()):
        own, total, like = [F.get(f["classes"], F.lit(i)) for i in range(N_CLASSES)], all_chars, classes
        if not name:  # characters of no class are left out on both sides
            own, like = [*own[:WIDE], *own[WIDE + 1 :]], [c / (1 - classes[WIDE]) for i, c in enumerate(classes) if i != WIDE]
            total = all_chars - F.get(f["classes"], F.lit(WIDE))
        class_d = F.when(f["lang"] == name, F.when(2 * total >= all_chars, js_distance(own, total, like))).otherwise(class_d)
        if hits:
            own = [F.get(f["hits"], F.lit(i)) for i in range(len(hits))]
            rest = F.greatest(F.lit(0.0), n - sum(own[1:], own[0]))
            one = js_distance([*own, rest], n.cast("double"), [*hits, max(0.0, 1 - sum(hits))])
            word_d = F.when(f["lang"] == name, one).otherwise(word_d)
            limit = F.when(f["lang"] == name, F.lit(word_limit(hits))).otherwise(limit)
    class_d = F.when(all_chars >= MIN_CLASS_CHARS, class_d)
    word_d = F.when(n >= MIN_WORD_COUNT, word_d)
    base = (n < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    kept = ~base & (F.coalesce(class_d, F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce(word_d, F.lit(0.0)) <= limit)
    return base, class_d, word_d, kept


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", refs: dict[str, Reference] | None = None) -> DataFrame:
    """One row per document: its id, its counts, the verdict and both distances."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    base, class_d, word_d, kept = verdict(refs or references())
    return measured(own).select(
        F.col("id").alias(id_col),
        *[F.col("__vg_q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        kept.alias("kept"),
        F.round(class_d, 6).alias("class_distance"),
        F.round(word_d, 6).alias("word_distance"),
    )


def keep_clean(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: dict[str, Reference] | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    return measured(docs, text_col, lang_col).filter(verdict(refs or references())[-1]).select(*[F.col(f"`{c}`") for c in docs.columns])

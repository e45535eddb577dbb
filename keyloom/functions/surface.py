"""Surfaces of tokens and pairs of them: tails, normal forms, geometry of an edit, classes of errors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions import text as X

#: White space of any kind, as a character class that Java's and RE2's patterns share.
WS, NOT_WS = r"[\t-\r\x{85}\p{Z}]", r"[^\t-\r\x{85}\p{Z}]"
CONTEXT_WORDS, LONGEST = 5, 24


def trailing_whitespace(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, WS + r"+\z", ""))


def last_ws_token(c: Column) -> Column:
    """What follows the last white space; null where nothing does."""
    return F.nullif(F.regexp_extract(c, f"({NOT_WS}+)\\z", 1), F.lit(""))


def last_alphabetic_token(c: Column) -> Column:
    """The last run of letters, whatever follows it."""
    return F.nullif(F.regexp_extract(c, r"(\p{L}+)[^\p{L}]*\z", 1), F.lit(""))


def previous_token(c: Column, before: Column) -> Column:
    """The last segment that isn't white space among the first `before` segments."""
    parts = F.slice(X.segments(c), F.lit(1), F.greatest(before, F.lit(0)))
    return F.get(F.reverse(F.filter(parts, lambda s: ~s["is_ws"])), F.lit(0))["text"]


def is_cyrillic_word(c: Column) -> Column:
    return c.rlike("^[а-яА-ЯёЁ-]+$")


def is_cyrillic_letters(c: Column) -> Column:
    return c.rlike("^[а-яА-ЯёЁ]+$")


def alpha_is_low(c: Column) -> Column:
    """Letters make less than half of what isn't white space."""
    return 2 * X.count_of(c, r"\p{L}") < F.greatest(X.count_of(c, NOT_WS), F.lit(1))


def context_token(c: Column) -> Column:
    """Without ASCII punctuation and quotation marks at the ends."""
    edge = "[!-/:-@\\[-`{-~«»“”„…]+"
    return F.regexp_replace(F.regexp_replace(c, f"^{edge}", ""), f"{edge}$", "")


def normal_surface(c: Column) -> Column:
    """Trimmed, lower-cased; null unless 1 to 24 letters, hyphens and apostrophes."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike(r"^[\p{L}'-]+$") & (F.length(low) <= LONGEST), low)


def lexical_surface(c: Column) -> Column:
    """Trimmed, lower-cased, without the marks that end sentences and clauses at its ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "^[!,.?;:]+", ""), "[!,.?;:]+$", ""))


def memory_word(c: Column) -> Column:
    """Lower-cased between its outermost letters and hyphens; empty without a letter."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[^\p{L}-]+", ""), r"[^\p{L}-]+$", "")
    return F.when(bare.rlike(r"\p{L}"), F.lower(bare)).otherwise("")


def memory_words(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, WS + "+"), memory_word), lambda w: w != "")


def recent_words(words: Column, n: int = CONTEXT_WORDS) -> Column:
    """The last n of an array."""
    return F.slice(words, F.greatest(F.size(words) - n, F.lit(0)) + 1, F.lit(n))


def context_and_last(c: Column) -> Column:
    """struct(context, word): the last word and up to five before it."""
    words = memory_words(c)
    before = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.when(F.size(words) > 0, F.struct(recent_words(before).alias("context"), F.get(F.reverse(words), F.lit(0)).alias("word")))


def changed_targets(a: Column, b: Column) -> Column:
    """Indexes, from 0, of the words of b that a has otherwise or not at all; the last where all are alike."""
    found = F.filter(F.transform(b, lambda w, i: F.when(~F.get(a, i).eqNullSafe(w), i)), lambda i: i.isNotNull())
    return F.when((F.size(found) == 0) & (F.size(b) > 0), F.array(F.size(b) - 1)).otherwise(found)


def transition_context(a: Column, b: Column) -> Column:
    """Up to five words of text a before the first that text b changes."""
    x, y = memory_words(a), memory_words(b)
    start = F.coalesce(F.get(changed_targets(x, y), F.lit(0)), F.greatest(F.size(x) - 1, F.lit(0)))
    return recent_words(F.slice(x, F.lit(1), F.least(start, F.size(x))))


def left_context_changed(a: Column, b: Column) -> Column:
    """Whether anything but the last word differs."""
    head = lambda w: F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    return head(X.normalized_words(a)) != head(X.normalized_words(b))


def phrase_case(original: Column, replacement: Column) -> Column:
    """The replacement with a first capital where the original has one."""
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substr(replacement, F.lit(2)))
    return F.when(original.rlike(r"^\p{Lu}"), capital).otherwise(replacement)


def protected_ascii(c: Column) -> Column:
    """ASCII tokens that look like addresses, paths, acronyms or brands; lexicons add to it by joins."""
    shaped = X.has_domain_dot(c) | c.rlike(r"[@/\\]") | X.is_acronym(c) | X.is_brand(c)
    return X.has_latin(c) & X.is_ascii(c) & shaped


def _with_token(parts: Column, at: Column, then) -> Column:
    """The segments joined, the one at a place replaced by then(segment); the place is worked out once."""
    bound = F.array(F.struct(parts.alias("parts"), at.alias("at")))
    return F.get(F.transform(bound, lambda z: F.array_join(F.transform(z["parts"], lambda s, i: F.when(i == z["at"], then(s)).otherwise(s["text"])), "")), F.lit(0))


def flip_token(c: Column, index: Column) -> Column:
    """The text with one token on the other layout: the index-th, from 0, or from the end if below 0."""
    parts = X.segments(c)
    spots = F.filter(F.transform(parts, lambda s, i: F.when(~s["is_ws"], i)), lambda i: i.isNotNull())
    return _with_token(parts, F.get(spots, F.when(index < 0, F.size(spots) + index).otherwise(index)), lambda s: X.project(s["text"]))


def model_normal(c: Column) -> Column:
    """Lower case, ё as е, without punctuation but hyphens, single spaces."""
    bare = F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[^\p{L}\p{N}_\t-\r\x{85}\p{Z}-]+", "")
    return F.trim(F.regexp_replace(bare, WS + "+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of the normal forms; 1 where they are equal."""
    x, y = model_normal(a), model_normal(b)
    return F.when(x == y, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


# Geometry of an edit from word a to word b


def _middle(a: Column, b: Column) -> tuple[Column, Column]:
    """What remains of both between their common ends."""
    lead = X.common_prefix(a, b)
    tail = F.least(X.common_prefix(F.reverse(a), F.reverse(b)), F.least(F.length(a), F.length(b)) - lead)
    return F.substr(a, lead + 1, F.length(a) - lead - tail), F.substr(b, lead + 1, F.length(b) - lead - tail)


def is_internal_move(a: Column, b: Column) -> Column:
    """One character moved inside a word of five or more whose ends stay."""
    x, y = _middle(a, b)
    n = F.length(x)
    first, rest = (lambda s: F.substring(s, 1, 1)), (lambda s: F.substr(s, F.lit(2)))
    last, head = (lambda s: F.substr(s, n, F.lit(1))), (lambda s: F.substr(s, F.lit(1), n - 1))
    moved = ((rest(x) == head(y)) & (first(x) == last(y))) | ((head(x) == rest(y)) & (last(x) == first(y)))
    ends = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.substring(a, -1, 1) == F.substring(b, -1, 1))
    return (F.length(a) == F.length(b)) & (F.length(a) >= 5) & (a != b) & ends & moved


def sparse_omissions(a: Column, b: Column) -> Column:
    """2 or 3 where a is b less so many characters that don't all stand together, the last one kept; else null."""
    missing = F.length(b) - F.length(a)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("gone"), F.lit(0).alias("i"))

    def step(s, ch):
        hit = F.substr(a, s["at"] + 1, F.lit(1)) == ch
        return F.struct((s["at"] + hit.cast("int")).alias("at"), F.when(hit, s["gone"]).otherwise(F.concat(s["gone"], F.array(s["i"]))).alias("gone"), (s["i"] + 1).alias("i"))

    walked = F.aggregate(X.chars(b), zero, step)
    gone = walked["gone"]
    together = F.array_max(gone) - F.array_min(gone) == F.size(gone) - 1
    start = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) | F.array_contains(gone, F.lit(0))
    whole = (walked["at"] == F.length(a)) & (F.size(gone) == missing) & ~F.array_contains(gone, F.length(b) - 1) & ~together & start
    return F.when(missing.isin(2, 3) & (F.substring(a, -1, 1) == F.substring(b, -1, 1)) & whole, missing)


def removes_one(a: Column, b: Column) -> Column:
    """Whether b is a less one character."""
    x, y = _middle(a, b)
    return (F.length(a) == F.length(b) + 1) & (F.length(x) == 1) & (F.length(y) == 0)


def removes_repeated(a: Column, b: Column) -> Column:
    """Whether b is a less one of two equal neighbours."""
    return removes_one(a, b) & F.array_contains(X.repeated_run_deletions(a), b)


def damage_priority(a: Column, b: Column) -> Column:
    """4: neighbours exchanged; 3: scattered omissions; 2: one character missing; 0: anything else."""
    return F.when(X.is_adjacent_transposition(a, b), 4).when(sparse_omissions(a, b).isNotNull(), 3).when(removes_one(b, a), 2).otherwise(0)


def typo_class(a: Column, b: Column, declared: Column) -> Column:
    """The class of an error that turned word b into a; the declared class where they are equal, or where it says more than a typo's."""
    collapsed = F.regexp_replace(a, r"(.)\1+", "$1") == F.regexp_replace(b, r"(.)\1+", "$1")
    typo = declared.isin("missing-letter", "sparse-internal-multi-omission", "extra-letter", "repeated-letter", "adjacent-transposition", "letter-substitution", "unknown")
    found = F.when(a == b, declared).when(X.is_adjacent_transposition(a, b) | is_internal_move(a, b), "adjacent-transposition")
    found = found.when(collapsed & (F.length(a) > F.length(b)) | removes_repeated(a, b), "repeated-letter").when(removes_one(a, b), "extra-letter").when(removes_one(b, a), "missing-letter")
    found = found.when(sparse_omissions(a, b).isNotNull(), "sparse-internal-multi-omission").when((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 1) == 1), "letter-substitution")
    return found.when(typo, "composite-typo").otherwise(declared)


def loses_words(a: Column, b: Column, rule: Column) -> Column:
    """Whether a correction has fewer words than a text of two or more, and no rule that joins them made it."""
    n = lambda c: X.count_of(c, NOT_WS + "+")
    return (n(a) >= 2) & (n(b) < n(a)) & ~rule.isin("split_word_pair", "glued_phrase", "moved_prefix_pair")


def over_compresses(a: Column, b: Column, error: Column) -> Column:
    """Three letters or more lost of a Cyrillic word of six or more, outside of classes that explain it."""
    plain = ~error.isin("wrong-layout", "partial-layout", "split-word", "glued-words", "repeated-letter")
    return plain & is_cyrillic_letters(a) & is_cyrillic_letters(b) & (F.length(a) >= 6) & (F.length(b) + 3 <= F.length(a))


# Texts


def reject_reason(c: Column) -> Column:
    """Why a phrase isn't kept: unsafe_text or low_language_quality; null if it is."""
    t = F.trim(F.regexp_replace(c, WS + "+", " "))
    unsafe = (t == "") | t.contains("://") | t.contains("@") | t.contains("=") | t.rlike(r"[\x00-\x1f\x7f]") | t.rlike(r"^[!-/:-@\[-`{-~…]") | t.rlike(r"(^| )-[^ ]")
    return F.when(unsafe, "unsafe_text").when(alpha_is_low(t), "low_language_quality")


def preferred_russian(c: Column, fallback: Column) -> Column:
    """Whether a text is typed on the Russian layout: by the script that has more letters, the fallback where both have as many."""
    ru, us = X.count_of(c, "[а-яА-ЯёЁ]"), X.count_of(c, "[A-Za-z]")
    return F.when(ru > us, True).when(us > ru, False).otherwise(fallback)


def mixed_case(c: Column) -> Column:
    """Cyrillic words of two letters or more with capitals here and there, lower-cased but for a first capital; else null."""
    lower = F.lower(c)
    odd = c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}") & is_cyrillic_word(c) & (F.length(c) >= 2)
    fixed = F.when(c.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(c, 1, 1)), F.substr(lower, F.lit(2)))).otherwise(lower)
    return F.when(odd & (fixed != c), fixed)


def safe_replacement(a: Column, b: Column, known: Column) -> Column:
    """Whether a learned replacement may be applied: it changes the text, has three words at most, and of a single word neither
    loses two letters or more nor becomes a short word, unless the target's words are known."""
    x, y = F.trim(a), F.trim(b)
    words = lambda c: X.count_of(c, NOT_WS + "+")
    letters = lambda c: X.count_of(c, r"\p{L}")
    short = (letters(y) + 1 < letters(x)) | ((words(y) == 1) & (letters(y) <= 3))
    return (x != "") & (y != "") & (x != y) & (words(y) <= 3) & ((words(x) > 1) | known | ~short)


def replace_word_before_last(c: Column, replacement: Column) -> Column:
    """The second-last word exchanged, in its casing, what stands around it as it is; null without two words, or where nothing changes."""
    parts = X.segments(c)
    spots = F.filter(F.transform(parts, lambda s, i: F.when(s["text"].rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())

    def exchanged(s):
        e = X.edge_punctuation(s["text"])
        return F.concat(e["lead"], X.word_case(e["core"], replacement), e["trail"])

    return F.when(F.size(spots) >= 2, F.nullif(_with_token(parts, F.get(spots, F.size(spots) - 2), exchanged), c))


def boundary_shifted(a: Column, b: Column) -> Column:
    """Whether b is a with one letter moved over the space between two words: the same letters, as many words, two changed."""
    x, y = X.normalized_words(a), X.normalized_words(b)
    changed = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])))
    moved = F.exists(F.sequence(F.lit(0), F.greatest(F.size(x) - 2, F.lit(0))), lambda i: F.abs(F.length(F.get(x, i)) - F.length(F.get(y, i))) == 1)
    return (F.size(x) >= 2) & (F.size(x) == F.size(y)) & (F.array_join(x, "") == F.array_join(y, "")) & (changed == 2) & F.coalesce(moved, F.lit(False))

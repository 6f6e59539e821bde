"""Text functions as native column expressions: tokens, stems, previews, references, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words a preview keeps.
PREVIEW_WORDS = 100
#: Extensions that make a word a file reference.
FILE_EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "py", "md", "go", "java", "rb", "c", "cpp", "h")
#: Path parts that mark library code.
LIBRARY_MARKERS = ("node_modules/", ".venv/", "site-packages/", "/dist/", "/build/", "/target/", ".eggs/", ".npm/", ".cache/")
#: Stemming steps of (suffix, what replaces it, least length left, whether a doubled
#: final consonant is made single, endings that forbid the rule).
STEM_STEPS = (
    (("ies", "y", 2, False, ()), ("es", "", 3, False, ()), ("s", "", 3, False, ("ss", "us", "is"))),
    (("ied", "y", 2, False, ()), ("ing", "", 4, True, ()), ("ed", "", 4, True, ())),
    (("ization", "ize", 3, False, ()), ("ation", "ate", 3, False, ()), ("tion", "t", 3, False, ()), ("sion", "s", 3, False, ()), ("ment", "", 4, False, ()), ("ness", "", 3, False, ())),
    (("er", "", 4, True, ()), ("or", "", 4, False, ())),
    (("e", "", 3, False, ()),),
)


def stems(words: Column) -> Column:
    """Suffix stripping of an array of words, in the steps of `STEM_STEPS`, at most one rule each; only
    ASCII words of four letters or more change.

    Each step is a `transform` of its own: its variable stands for the word, where nested
    expressions would repeat all earlier steps in every rule.
    """

    def apply(w: Column, rules: tuple) -> Column:
        out = None
        for suffix, new, least, single, forbidden in rules:
            left = F.substring(w, F.lit(1), F.length(w) - len(suffix))
            fits = w.endswith(suffix) & (F.length(w) >= least + len(suffix))
            for ending in forbidden:
                fits = fits & ~w.endswith(ending)
            value = F.regexp_replace(left, r"([^aeiou])\1$", "$1") if single else F.concat(left, F.lit(new))
            out = F.when(fits, value) if out is None else out.when(fits, value)
        return out.otherwise(w)

    # what must not change goes through the steps behind a mark that no suffix matches
    fit = r"^[\x00-\x7F]{4,}$"
    marked = F.transform(words, lambda w: F.when(w.rlike(fit), w).otherwise(F.concat(w, F.lit("\u0001"))))
    done = reduce(lambda ws, rules: F.transform(ws, lambda w: apply(w, rules)), STEM_STEPS, marked)
    return F.transform(done, lambda w: F.rtrim(w, F.lit("\u0001")))


#: Words that some rule may change.
_MAY_CHANGE = "(?:" + "|".join(sorted({rule[0] for rules in STEM_STEPS for rule in rules})) + ")$"


def stem(word: Column) -> Column:
    """`stems` of one word; without a rule's suffix it stays as it is."""
    return F.when(word.rlike(_MAY_CHANGE), F.element_at(stems(F.array(word)), 1)).otherwise(word)


def split_camel(text: Column) -> Column:
    """Blanks between lower case or digit and upper case, and before the last of a run of capitals that lower case follows."""
    runs = F.regexp_replace(text, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 ")
    return F.regexp_replace(runs, r"([\p{Ll}0-9])(?=\p{Lu})", "$1 ")


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens before stemming: parted at white space, `_` and camel case, ends stripped of all but letters, marks and digits."""
    apart = split_camel(F.replace(F.coalesce(text, F.lit("")), F.lit("_"), F.lit(" ")))
    bare = F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{N}](?:[^\s\p{Z}]*[\p{L}\p{N}\p{M}])?"), F.lit(0))
    return F.transform(bare, F.lower)


#: Where `split_camel` sets a blank: both sides belong to tokens, so that each is one token more.
_CAMEL = r"\p{Lu}(?=\p{Lu}\p{Ll})|[\p{Ll}0-9](?=\p{Lu})"


def token_count(text: Column) -> Column:
    """How many `raw_tokens` a text has, without cutting it: what stands between white space and `_` and holds a letter or digit, and each change of case."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}][^\s\p{Z}_]*+")) + F.regexp_count(text, F.lit(_CAMEL))


def tokens(text: Column) -> Column:
    """Stemmed tokens of a text, in order, repeats kept."""
    return stems(raw_tokens(text))


def preview(text: Column, words: int = PREVIEW_WORDS) -> Column:
    """The text itself if it has no more words than that; else these words, one blank between, and `...`."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.when(F.size(parts) <= words, F.coalesce(text, F.lit(""))).otherwise(F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("...")))


def line_of(metadata: Column) -> Column:
    """Line number in JSON metadata: `line`, else `start_line`; null unless a non-negative integer."""

    def number(key: str) -> Column:
        raw = F.get_json_object(metadata, f"$.{key}")
        return F.when(raw.rlike(r"^[0-9]{1,18}$"), raw.cast("bigint"))

    return F.coalesce(number("line"), number("start_line"))


def category(path: Column) -> Column:
    """`library` for paths with a library marker, else `module`."""
    return F.when(reduce(lambda a, b: a | b, [path.contains(m) for m in LIBRARY_MARKERS]), "library").otherwise("module")


def hit_path(node_id: Column) -> Column:
    """Path that search shows for an entity: what stands before the first colon."""
    return F.substring_index(node_id, ":", 1)


def group_path(node_id: Column) -> Column:
    """Path by which results are diversified: cut at the last `::`, else at the last `:`."""
    double = F.regexp_extract(node_id, r"(?s)^(.*)::", 1)
    single = F.regexp_extract(node_id, r"(?s)^(.*):", 1)
    return F.when(node_id.contains("::"), double).when(node_id.contains(":"), single).otherwise(node_id)


def decay(created_at: Column, now: Column | int, rate: float = 0.05) -> Column:
    """exp(-rate * hours of age); 1 for times to come."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.exp(F.lit(-rate) * F.greatest(now - created_at, F.lit(0)) / 3600.0)


def strip_frontmatter(text: Column) -> Column:
    """Markdown without the leading block between `---` lines."""
    return F.regexp_replace(text, r"\A\s*---[ \t]*\r?\n(?s:.*?)\n---[ \t]*(?:\r?\n)*", "")


def inline_code(text: Column) -> Column:
    """Distinct trimmed texts between pairs of backticks, first seen first; an unpaired rest is left out."""
    pieces = F.split(text, "`", -1)
    odd = F.filter(pieces, lambda x, i: (i % 2 == 1) & (i < F.size(pieces) - 1))
    return F.array_distinct(F.filter(F.transform(odd, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def file_references(text: Column) -> Column:
    """Distinct words that look like file paths: a known extension with something before it, and a `/` or a leading letter."""
    outer = r"^[^\p{L}\p{N}/.]+|[^\p{L}\p{N}/.]+$"
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"^`+|`+$", ""), outer, ""), r"\.+$", ""), outer, ""))
    known = r"(?s)^.+\.(?:" + "|".join(FILE_EXTENSIONS) + ")$"
    return F.array_distinct(F.filter(words, lambda w: w.rlike(known) & (w.contains("/") | w.rlike(r"^\p{L}"))))


def content_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def uri_to_path(uri: Column) -> Column:
    """A file URI's path; anything else as it is."""
    return F.when(uri.startswith("file://"), F.substr(uri, F.lit(8))).otherwise(uri)

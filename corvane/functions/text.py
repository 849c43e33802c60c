"""Text functions: all return columns, none runs Python on rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NEGATORS = ("no", "not", "without", "lacks", "lacking", "absent", "none", "sans", "minus")
LABEL_PREFIXES = ("apply_", "introduce_")
LABEL_SUFFIXES = ("_effect", "_filter", "_tool")
UNIT_SUFFIXES = ("_hz", "_db", "_ms", "_seconds")
UNITLESS = ("normalized", "ratio", "q")
LEAK_PATTERNS = ("->", r"\w+\([A-Za-z_]+\s*=")
JSON_FAILURES = ("omission", "wrong_interpretation", "hallucination")


def strings(values: Sequence[str]) -> Column:
    """An array literal of strings, typed even if empty."""
    return F.array(*map(F.lit, values)).cast("array<string>")


def tokenize(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1), lambda t: t != "")


def squash(text: Column) -> Column:
    """What is left of the lower-cased text if all but a-z and 0-9 goes."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def squashed(value: str) -> str:
    return "".join(c for c in value.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def tags_with_prefix(tags: Column, domain: str, mark: str = "---") -> Column:
    """The distinct tags of one domain, sorted, without ``domain---``."""
    head = domain + mark
    return F.sort_array(F.array_distinct(F.transform(F.filter(tags, lambda t: t.startswith(head)), lambda t: F.substring(t, len(head) + 1, 1 << 30))))


def is_negated(tokens: Column, negators: Sequence[str] = NEGATORS) -> Column:
    """Does the phrase begin with a negation?"""
    return F.coalesce(F.get(tokens, F.lit(0)).isin(*negators), F.lit(False))


def tag_candidates(phrase: Column) -> Column:
    """Spellings to look up, best first: the whole phrase without separators, then its tokens from the last to the first, each as it
    is and with its final s taken off or added. A negated phrase has none."""
    tokens = tokenize(phrase)
    ordered = F.concat(F.array(F.array_join(tokens, "")), F.reverse(tokens))
    both = F.flatten(F.transform(ordered, lambda c: F.array(c, F.when(c.endswith("s"), F.regexp_replace(c, "s$", "")).otherwise(F.concat(c, F.lit("s"))))))
    return F.when((F.size(tokens) == 0) | is_negated(tokens), F.array().cast("array<string>")).otherwise(both)


def resolve_tag(phrase: Column, vocabulary: Sequence[str]) -> Column:
    """The first candidate in a vocabulary that is small enough for a literal; null without any."""
    known = strings(vocabulary)
    return F.get(F.filter(tag_candidates(phrase), lambda c: F.array_contains(known, c)), F.lit(0))


def resolve_tags(rows: DataFrame, phrase: str, vocabulary: DataFrame, tag: str = "tag", out: str = "resolved") -> DataFrame:
    """rows with the first candidate of ``phrase`` in a vocabulary table of any size; each distinct phrase is looked up once."""
    phrases = rows.select(F.col(phrase).alias("_phrase")).distinct().select("_phrase", F.posexplode(tag_candidates(F.col("_phrase"))).alias("_at", "_tag"))
    found = phrases.join(vocabulary.select(F.col(tag).alias("_tag")).distinct(), "_tag").groupBy("_phrase").agg(F.min_by("_tag", "_at").alias(out))
    return rows.join(found, F.col(phrase).eqNullSafe(F.col("_phrase")), "left").drop("_phrase")


def mine_vocabulary(text: Column, words: Sequence[str]) -> Column:
    """The entries of words all of whose tokens are tokens of the text, in the order given."""
    tokens = tokenize(text)
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).otherwise(F.filter(strings(words), lambda w: F.size(F.array_except(tokenize(w), tokens)) == 0))


def mine_phrases(phrases: Column, words: Sequence[str]) -> Column:
    """Distinct sorted entries that any phrase of an array holds."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(phrases, lambda p: mine_vocabulary(p, words)))))


def unclaimed(phrases: Column, claimed: Sequence[str], stop: Sequence[str] = ()) -> Column:
    """The phrases of an array that resolve to no entry of ``claimed`` and hold no stop word."""
    return F.filter(phrases, lambda p: resolve_tag(p, claimed).isNull() & (F.size(mine_vocabulary(p, stop)) == 0))


def normalize_label(query: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """struct(canonical, confidence, source): the name whose alias is the query, else the first whose alias tokens it all holds.

    A name is its own alias; an alias given to several names stands for the last one, at the place of the first.
    """
    table: dict[str, str] = {}
    for name, others in aliases.items():
        for alias in (name, *others):
            spelled = " ".join(squashed(w) for w in _words(alias))
            if spelled:
                table[spelled] = name
    tokens = tokenize(query)
    entries = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name")) for a, n in table.items()])
    exact = F.get(F.filter(entries, lambda e: e["alias"] == F.array_join(tokens, " ")), F.lit(0))["name"]
    part = F.get(F.filter(entries, lambda e: F.size(F.array_except(F.split(e["alias"], " "), tokens)) == 0), F.lit(0))["name"]
    found = F.coalesce(exact, part)
    return F.struct(found.alias("canonical"), F.when(found.isNull(), 0.0).otherwise(1.0).alias("confidence"), F.when(found.isNull(), "unmatched").otherwise("alias").alias("source"))


def _words(value: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in value.lower()).split()


def cue_flags(text: Column, cues: Mapping[str, Sequence[str]]) -> Column:
    """map(cue -> bool): does any phrase of the cue occur as a run of whole words?"""
    padded = F.concat(F.lit(" "), F.array_join(tokenize(text), " "), F.lit(" "))

    def hit(phrases: Sequence[str]) -> Column:
        needles = [" ".join(_words(p)) for p in phrases]
        return reduce(lambda a, b: a | b, [padded.contains(f" {n} ") for n in needles if n], F.lit(False))

    return F.create_map(*[x for name, phrases in cues.items() for x in (F.lit(name), hit(phrases))])


def mentions(words: Column, candidate: Column) -> Column:
    """Does some run of consecutive whole words, written without spaces, begin with the candidate? An empty one is never mentioned."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    return (candidate != "") & (F.size(words) > 0) & F.exists(starts, lambda i: F.array_join(F.slice(words, i, F.size(words)), "").startswith(candidate))


def mentions_any(text: Column, candidates: Sequence[str]) -> Column:
    """The same on a text for several candidates. A run of words is a match at a word start of the words' concatenation, so one
    pattern with optional separators finds it."""
    pattern = "|".join("[^a-z0-9]*".join(squashed(c)) for c in candidates if squashed(c))
    return F.lower(text).rlike(f"(?<![a-z0-9])(?:{pattern})") if pattern else F.lit(False)


def parse_list(value: Column, quoted_only: bool = False) -> Column:
    """Items of a list literal ``['a', "b"]``; a bare quoted string is one item. quoted_only: single-quoted items anywhere.

    What doesn't read as such a list gives an empty array.
    """
    text = F.trim(F.coalesce(value, F.lit("")))
    if quoted_only:
        return F.filter(F.transform(F.regexp_extract_all(text, F.lit("'([^']+)'"), 1), lambda x: F.trim(x)), lambda x: x.isNotNull())
    item = r"""(?:'[^']*'|"[^"]*")"""
    whole = text.rlike(rf"^(?:\[\s*(?:{item}\s*(?:,\s*{item}\s*)*,?\s*)?\]|{item})$")
    items = F.transform(F.regexp_extract_all(text, F.lit(f"({item})"), 1), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(whole, items).otherwise(F.array().cast("array<string>"))


def parse_names(value: Column) -> Column:
    """Names of a free list: ``a, b``, ``['a', 'b']``, ``none``; stripped of brackets and quotes, empty ones and none dropped."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[,;\n]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\[\]\"']+|[\s\[\]\"'.]+$", "")))
    return F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin("none", "n/a", "null"))


def parse_key_mode(value: Column) -> Column:
    """struct(key, mode) of the first item of a list literal such as ``['A minor']``."""
    return key_mode(parse_list(value))


def key_mode(items: Column) -> Column:
    """struct(key, mode) of the first of the items of a list; for lists that are parsed already."""
    raw = F.nullif(F.trim(F.get(items, F.lit(0))), F.lit(""))
    parts = F.split(raw, r"\s+")
    return F.struct(F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise(raw).alias("key"), F.when(F.size(parts) >= 2, F.lower(F.get(parts, F.lit(1)))).alias("mode"))


def parse_tempo(text: Column) -> Column:
    """The number before the first ``bpm``; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?i)(\d+(?:\.\d+)?)\s*bpm", 1), F.lit("")).try_cast("double")


NUMBER = r"^\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\s*(?::\s*1)?\s*$"


def to_number(text: Column) -> Column:
    """A decimal number, a ratio ``n : 1`` included; null for anything else and for what isn't finite."""
    value = F.nullif(F.regexp_extract(text.cast("string"), NUMBER, 1), F.lit("")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def duration(start: Column, end: Column) -> Column:
    """Seconds between two texts of seconds, to the millisecond; null if either is none."""
    return F.round(to_number(end) - to_number(start), 3)


def parse_bool(text: Column) -> Column:
    """true, 1, yes (any case): true; empty and null: null; else false."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.lower(F.trim(text)).isin("true", "1", "yes"))


def clean_int(text: Column) -> Column:
    """The digits of a text as a number; null without any."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("long")


def slugify(text: Column, empty: str = "full_mix") -> Column:
    """Lower case, every character that is no letter or digit as _, none at the ends."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit(empty)).otherwise(slug)


def readable_label(name: Column) -> Column:
    """An operator or parameter name as words: its usual prefixes, suffixes and units go, once each in their order."""
    for prefix in LABEL_PREFIXES:
        name = F.regexp_replace(name, f"^{prefix}", "")
    for suffix in (*LABEL_SUFFIXES, *UNIT_SUFFIXES):
        name = F.regexp_replace(name, f"{suffix}$", "")
    return F.trim(F.replace(name, F.lit("_"), F.lit(" ")))


def format_value(value: Column, precision: int, unit: str | None = None, shown: Mapping[str, str] = {}) -> Column:
    """value rounded half to even, without trailing zeros, and its unit unless that only names a scale."""
    places = max(0, precision)
    text = F.format_string(f"%.{places}f", F.bround(value.cast("double"), places))
    if places:
        text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    text = F.when(text == "-0", "0").otherwise(text)
    return text if not unit or unit.lower() in UNITLESS else F.concat(text, F.lit(f" {shown.get(unit.lower(), unit)}"))


def value_renderings(value: Column, precision: int) -> Column:
    """Accepted spellings of a number without separators: as stored, rounded to its precision up to four places, in thousands."""
    size = F.abs(value.cast("double"))
    forms = [size.cast("string"), *[format_value(size, p) for p in range(max(0, precision), 5)]]
    forms += [F.when(size >= 1000, F.concat(format_value(size / 1000, 4), F.lit("k"))), F.when(size == F.floor(size), F.floor(size).cast("string"))]
    return F.array_distinct(F.transform(F.array_compact(F.array(*forms)), squash))


def interpolate(template: str, values: Mapping[str, Column]) -> Column:
    """``${path}`` replaced by values; a template that is one placeholder keeps the value's type."""
    if template.startswith("${") and template.endswith("}") and template.count("${") == 1:
        return values[template[2:-1]]
    parts, rest = [], template
    while "${" in rest:
        before, _, rest = rest.partition("${")
        path, _, rest = rest.partition("}")
        parts += [F.lit(before), values[path].cast("string")]
    return F.concat(*parts, F.lit(rest))


def path_parts(path: Column) -> Column:
    """struct(folder, stem, suffix, shard) of a slash-separated path; shard is the last run of digits of the stem."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.struct(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), stem.alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("suffix"), F.nullif(F.regexp_extract(stem, r"(\d+)\D*$", 1), F.lit("")).alias("shard"))


def clip_of_path(path: Column, roots: Sequence[str] = ("renders", "counterfactual"), audio: str = "audio") -> Column:
    """The clip that a relative path belongs to: the folder below one of roots, or the stem of the file or folder below ``audio``;
    else null."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    found = F.when(first.isin(*roots), second).when(first == audio, F.regexp_replace(second, r"(?<=.)\.[^.]*$", ""))
    return F.when(~F.startswith(path, F.lit("/")), found)


def split_of_path(path: Column) -> Column:
    """The split that a numbered file of a data set names: its stem before -000."""
    return F.split_part(path_parts(path)["stem"], F.lit("-000"), F.lit(1))


def shard_of_path(path: Column, prefix: str, suffix: str = ".tar") -> Column:
    """The archive that holds a relative path, named by its first folder."""
    return F.concat(F.lit(prefix), F.split_part(path, F.lit("/"), F.lit(1)), F.lit(suffix))


def baseline_name(poisoned: Column, plan: Column, description: Column) -> Column:
    """File name of what an edit starts from: the poisoned input of a plan, the remix that a description names, or the original."""
    made = F.concat(F.lit("initial__"), slugify(F.coalesce(plan, F.lit("poisoned_initial"))), F.lit(".wav"))
    return F.when(F.coalesce(poisoned, F.lit(False)), made).when(description.isNull(), "original.wav").otherwise(F.concat(F.lit("original__"), slugify(description), F.lit(".wav")))


def derive_identifiers(registry: DataFrame, rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """keys, identifiers: names that only a machine writes, as they have an underscore: those of a registry (operator, params) and of
    the fields of a key's rows; sorted. The registry is configuration."""
    names = registry.select(F.explode(F.concat(F.array("operator"), F.coalesce("params", F.array().cast("array<string>")))).alias("_x")).where(F.contains("_x", F.lit("_")))
    fixed = names.agg(F.collect_set("_x").alias("_fixed"))
    own = rows.select(*keys, F.explode(F.array(*fields)).alias("_x")).groupBy(*keys).agg(F.collect_set(F.when(F.contains("_x", F.lit("_")), F.col("_x"))).alias("_own"))
    return own.crossJoin(F.broadcast(fixed)).select(*keys, F.array_sort(F.array_union("_fixed", "_own")).alias("identifiers"))


def role_mentions(rows: DataFrame, keep: Sequence[str], roles: Mapping[str, str], lexicon: Mapping[str, Sequence[str]]) -> DataFrame:
    """keep, role, family, term, start, end: spans of the terms in each role's text; roles: role -> column."""
    spoken = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("string").alias("text")) for r, c in roles.items()])).alias("_t")
    spans = rows.select(*keep, spoken).select(*keep, F.col("_t.role").alias("role"), F.explode(term_spans(F.col("_t.text"), lexicon)).alias("_s"))
    return spans.select(*keep, "role", "_s.family", "_s.term", "_s.start", "_s.end")


def extract_verdict(text: Column, values: Sequence[str], failures: Sequence[str] = JSON_FAILURES) -> Column:
    """struct(verdict, failures, problems) of the first to the last brace of a text.

    What isn't JSON, isn't an object or is outside the vocabulary is named in problems and gives no verdict.
    """
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.nullif(block, F.lit("")))
    verdict = F.try_variant_get(parsed, "$.verdict", "string")
    found = F.try_variant_get(parsed, "$.failures", "array<string>")
    listed = F.variant_get(parsed, "$.failures", "string").isNull() | found.isNotNull()
    unknown = F.array_except(F.coalesce(found, F.array().cast("array<string>")), strings(failures))
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty response").when(block == "", "no JSON object").when(parsed.isNull(), "not valid JSON"),
        F.when(parsed.isNotNull() & ~F.coalesce(verdict.isin(*values), F.lit(False)), "verdict outside the vocabulary"),
        F.when(parsed.isNotNull() & ~listed, "failures must be a list"),
        F.when(parsed.isNotNull() & (F.size(unknown) > 0), "unknown failures"),
    ))
    good = F.size(problems) == 0
    return F.struct(F.when(good, verdict).alias("verdict"), F.when(good, found).alias("failures"), problems.alias("problems"))


def leak_tokens(text: Column, identifiers: Sequence[str], patterns: Sequence[str] = LEAK_PATTERNS) -> Column:
    """Distinct identifiers with an underscore that stand as whole words in the text, then what the syntax patterns match, sorted."""
    names = sorted((i for i in set(identifiers) if "_" in i), key=lambda i: (-len(i), i))
    forms = ([r"(?<!\w)(?:" + "|".join(names) + r")(?!\w)"] if names else []) + list(patterns)
    none = F.array().cast("array<string>")
    extracted = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), 1)
    # A form that asks for a bracket is only looked for in texts that have one.
    found = [F.when(F.contains(text, F.lit("(")), extracted(p)).otherwise(none) if p == LEAK_PATTERNS[1] else extracted(p) for p in forms]
    return F.sort_array(F.array_distinct(F.concat(*found))) if found else F.array().cast("array<string>")


def text_checks(text: Column, forbidden: Sequence[str] = (), max_words: int | None = None) -> Column:
    """Violations: each forbidden pattern with its first match, then the number of words above the limit."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    found = [F.when(text.rlike(p), F.concat(F.lit(f"matched {p}: "), F.regexp_extract(text, p, 0))) for p in forbidden]
    if max_words is not None:
        found.append(F.when(words > max_words, F.concat(F.lit("used "), words.cast("string"), F.lit(f" words, limit is {max_words}"))))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def operator_tokens(operator: str) -> list[str]:
    """Spellings under which a text may name an operator: what its affixes leave, and the last part of that."""
    name = operator
    for prefix in LABEL_PREFIXES:
        name = name.removeprefix(prefix)
    for suffix in LABEL_SUFFIXES:
        name = name.removesuffix(suffix)
    return sorted({squashed(x) for x in (name, name.split("_")[-1]) if x})


def missing_mentions(text: Column, accepted: Mapping[str, Sequence[str]]) -> Column:
    """The names of which no accepted spelling is mentioned; names without any are exempt."""
    return F.array_compact(F.array(*[F.when(~mentions_any(text, spellings), F.lit(name)) for name, spellings in accepted.items() if spellings])) if accepted else F.array().cast("array<string>")


def missing_operators(text: Column, used: Column, accepted: Mapping[str, Sequence[str]], exempt: Sequence[str] = ()) -> Column:
    """The operators of an array, in its order, of which the text (a null one is empty) mentions no spelling: those of operator_tokens and of accepted
    (operator: further names), which has every operator that may be asked for. Exempt ones are never missing."""
    named = {o: [*operator_tokens(o), *names] for o, names in accepted.items() if o not in exempt}
    text = F.coalesce(text, F.lit(""))
    unheard = F.array_compact(F.array(*[F.when(~mentions_any(text, spellings), F.lit(o)) for o, spellings in named.items()])).cast("array<string>") if named else strings([])
    return F.filter(used, lambda o: F.array_contains(unheard, o))


def missing_stems(text: Column, stems: Column) -> Column:
    """The names in a map name -> accepted words, sorted, of which the text mentions none; names without any words are exempt."""
    words = tokenize(text)
    kept = F.map_filter(stems, lambda _, accepted: (F.size(accepted) > 0) & ~F.exists(accepted, lambda w: mentions(words, squash(w))))
    return F.sort_array(F.map_keys(kept))


def omissions(text: Column, operators: Column | None = None, stems: Column | None = None, values: Column | None = None) -> Column:
    """A sentence for each kind of thing that is missing in a text, from what the functions above have found."""
    found = []
    for missing, told in ((operators, "did not name operator(s) "), (stems, "did not name stem(s) "), (values, "omitted value(s) ")):
        if missing is not None:
            found.append(F.when(F.size(missing) > 0, F.concat(F.lit(told), F.array_join(missing, ", "))))
    return F.array_compact(F.array(*found)).cast("array<string>") if found else strings([])


def missing_values(text: Column, values: Column, precision: int) -> Column:
    """Entries of a map name -> number none of whose spellings is in the text, as name=value."""
    flat = squash(F.coalesce(text, F.lit("")))
    kept = F.map_filter(values, lambda _, v: ~F.exists(value_renderings(v, precision), lambda r: F.contains(flat, r)))
    return F.sort_array(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))


def term_spans(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """array of struct(family, term, start, end), sorted by start: whole-word terms of each family, longest first, offsets in
    characters of the lower-cased text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<family:string,term:string,start:int,end:int>>").alias("out"))

    def spans(family: str, terms: Sequence[str]) -> Column:
        pattern = r"(?<![a-z0-9])(?:" + "|".join(sorted(terms, key=lambda t: (-len(t), t))) + r")(?![a-z0-9])"
        hits = F.regexp_extract_all(lower, F.lit(f"({pattern})"), 1)
        before = F.transform(F.slice(F.split(lower, pattern, -1), 1, F.size(hits)), F.length)

        def step(a, x):
            start, end = a["at"] + x["before"], a["at"] + x["before"] + F.length(x["term"])
            span = F.struct(F.lit(family).alias("family"), x["term"].alias("term"), start.cast("int").alias("start"), end.cast("int").alias("end"))
            return F.struct(end.cast("int").alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(F.zip_with(before, hits, lambda p, h: F.struct(p.alias("before"), h.alias("term"))), zero, step, lambda a: a["out"])

    found = [spans(f, t) for f, t in lexicon.items()]
    return F.array_sort(F.concat(*found), lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["family"] < b["family"])), -1).when((a["start"] == b["start"]) & (a["family"] == b["family"]), 0).otherwise(1))


def stable_id(*values: Column) -> Column:
    """The first 24 hexadecimal digits of the SHA-256 of the values as a JSON array of strings."""
    return F.substring(F.sha2(F.to_json(F.array(*[v.cast("string") for v in values])), 256), 1, 24)


def stable_noise(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the SHA-256 of the parts, joined by |."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def content_key(path: Column, size: Column, modified: Column, model: str) -> Column:
    """Cache key of a file's content under a model."""
    return F.sha2(F.to_json(F.struct(path.alias("path"), size.alias("size"), modified.alias("modified"), F.lit(model).alias("model"))), 256)

"""Porter's stemming algorithm as column expressions, in three modes.

The rules are data; one small set of building blocks turns them into columns or into SQL text, so
the whole stemmer is a single expression that stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("NLTK_EXTENSIONS", "MARTIN_EXTENSIONS", "ORIGINAL_ALGORITHM")

# Irregular forms, suffix rules, and the consonant and vowel runs of the algorithm.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Words that end otherwise are changed by no step.
LAST = sorted({suffix[-1] for suffix in (*(s for s, _ in STEP_2 + STEP_3), *STEP_4, "s", "d", "g", "y", "i", "e", "l")})
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


class Columns:
    """Building blocks as Spark columns."""

    lit = staticmethod(F.lit)

    def ends(self, w, suffix):
        return w.endswith(suffix)

    def drop(self, w, n):
        return F.substring(w, 1, F.length(w) - n) if n else w

    def add(self, w, tail):
        return F.concat(w, F.lit(tail)) if tail else w

    def bind(self, value, f):
        return F.transform(F.array(value), f)[0]

    def matches(self, w, pattern):
        """A y at the start is a consonant: it is not left to the vowels that may follow."""
        return w.rlike(pattern.replace(f"^({C})?", f"^(?:{C}|(?!y))").replace("$", r"\z"))

    def length(self, w):
        return F.length(w)

    def last(self, w, n):
        return F.substring(w, -n, n)

    def equal(self, a, b):
        return a == b

    def both(self, *xs):
        out = xs[0]
        for x in xs[1:]:
            out = out & x
        return out

    def either(self, a, b):
        return a | b

    def no(self, a):
        return ~a

    def choose(self, cases, default):
        out = None
        for test, value in cases:
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(default)


class Sql:
    """The same as SQL text."""

    def ends(self, w, suffix):
        return f"suffix({w}, '{suffix}')"

    def drop(self, w, n):
        return f"left({w}, length({w}) - {n})" if n else w

    def add(self, w, tail):
        return f"({w} || '{tail}')" if tail else w

    def bind(self, value, f):
        return f(value)

    def matches(self, w, pattern):
        return f"regexp_matches(regexp_replace({w}, '^y', 'Y'), '{pattern}')"

    def length(self, w):
        return f"length({w})"

    def last(self, w, n):
        return f"right({w}, {n})"

    def equal(self, a, b):
        return f"{a} = '{b}'"

    def both(self, *xs):
        return "(" + " AND ".join(xs) + ")"

    def either(self, a, b):
        return f"({a} OR {b})"

    def no(self, a):
        return f"(NOT {a})"

    def choose(self, cases, default):
        return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in cases) + f" ELSE {default} END"


def steps(b, mode: str) -> list[Callable]:
    """The steps of the algorithm for a set of building blocks; each maps a word to a word."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode}")
    nltk, original = mode == MODES[0], mode == MODES[2]
    some = lambda w: b.matches(w, f"^({C})?{V}{C}")
    once = lambda w: b.matches(w, f"^({C})?{V}{C}({V})?$")
    more = lambda w: b.matches(w, f"^({C})?{V}{C}{V}{C}")
    vowel = lambda w: b.matches(w, f"^({C})?[aeiouy]")
    consonant_last = lambda w: b.matches(w, f"^({C})?({V}{C})*$")
    short = (lambda w: b.matches(w, "^" + C + "[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$")) if nltk else (lambda w: b.matches(w, "^" + C + "[aeiouy][^aeiouwxy]$"))

    def by_rules(w, rules):
        """First suffix that fits decides; where its condition fails the word stays."""
        by_letter = {}  # by the last letter first, so that most words meet few suffixes
        for suffix, tail, test in rules:
            stem = b.drop(w, len(suffix))
            changed = b.add(stem, tail)
            by_letter.setdefault(suffix[-1], []).append((b.ends(w, suffix), b.choose([(test(stem), changed)], w)))
        return b.choose([(b.ends(w, letter), b.choose(cases, w)) for letter, cases in by_letter.items()], w)

    def step_1a(w):
        cases = [(b.both(b.ends(w, "ies"), b.equal_length(w, 4)), b.drop(w, 1))] if nltk else []
        cases += [(b.ends(w, "sses"), b.drop(w, 2)), (b.ends(w, "ies"), b.drop(w, 2)), (b.ends(w, "ss"), w), (b.ends(w, "s"), b.drop(w, 1))]
        return b.choose([(b.ends(w, "s"), b.choose(cases, w))], w)

    def step_1b(w):
        cases_d = [(b.ends(w, "ied"), b.choose([(b.equal_length(w, 4), b.drop(w, 1))], b.drop(w, 2)))] if nltk else []
        cases_d.append((b.ends(w, "eed"), b.choose([(some(b.drop(w, 3)), b.drop(w, 1))], w)))
        cut = lambda s: (b.both(b.ends(w, s), vowel(b.drop(w, len(s)))), b.bind(b.drop(w, len(s)), repaired))
        return b.choose([(b.ends(w, "d"), b.choose([*cases_d, cut("ed")], w)), (b.ends(w, "g"), b.choose([cut("ing")], w))], w)

    def repaired(x):
        """The end of a word that step 1b has cut."""
        double = b.both(b.at_least_two_equal(x), consonant_last(x))
        lsz = b.either(b.either(b.ends(x, "l"), b.ends(x, "s")), b.ends(x, "z"))
        cases = [(b.ends(x, s), b.add(x, "e")) for s in ("at", "bl", "iz")]
        cases += [(double, b.choose([(lsz, x)], b.drop(x, 1))), (b.ends(x, "*d"), b.add(b.drop(x, 2), "d")), (b.both(once(x), short(x)), b.add(x, "e"))]
        return b.choose(cases, x)

    def step_1c(w):
        stem = b.drop(w, 1)
        test = b.both(b.longer(w, 2), consonant_last(stem)) if nltk else vowel(stem)
        return b.choose([(b.both(b.ends(w, "y"), test), b.add(stem, "i"))], w)

    def step_2_again(w):
        stem = b.drop(w, 4)
        return b.choose([(b.both(b.ends(w, "alli"), some(stem)), b.add(stem, "al"))], w)

    def step_2(w):
        rules = [(s, t, some) if s != "bli" or not original else ("abli", "able", some) for s, t in STEP_2]
        if nltk:
            rules += [("fulli", "ful", some), ("logi", "log", lambda stem: some(b.add(stem, "l")))]
        elif not original:
            rules.append(("logi", "log", some))
        return by_rules(w, rules)

    def step_3(w):
        return by_rules(w, [(s, t, some) for s, t in STEP_3])

    def step_4(w):
        after_s_or_t = lambda stem: b.both(more(stem), b.either(b.ends(stem, "s"), b.ends(stem, "t")))
        return by_rules(w, [(s, "", after_s_or_t if s == "ion" else more) for s in STEP_4])

    def step_5(w):
        stem = b.drop(w, 1)
        return b.choose([(b.both(b.ends(w, "e"), b.either(more(stem), b.both(once(stem), b.no(short(stem))))), stem)], w)

    def step_5b(w):
        return b.choose([(b.both(b.ends(w, "ll"), more(b.drop(w, 1))), b.drop(w, 1))], w)

    return [step_1a, step_1b, step_1c, *([step_2_again] if nltk else []), step_2, step_3, step_4, step_5, step_5b]


def _more(cls, **blocks):
    for name, f in blocks.items():
        setattr(cls, name, staticmethod(f))


_more(
    Columns,
    equal_length=lambda w, n: F.length(w) == n,
    longer=lambda w, n: F.length(w) > n,
    at_least_two_equal=lambda w: (F.length(w) > 1) & (F.substring(w, -1, 1) == F.substring(w, -2, 1)),
)
_more(
    Sql,
    equal_length=lambda w, n: f"length({w}) = {n}",
    longer=lambda w, n: f"length({w}) > {n}",
    at_least_two_equal=lambda w: f"(length({w}) > 1 AND right({w}, 1) = left(right({w}, 2), 1))",
)


def stem(word: Column, mode: str = MODES[0], to_lowercase: bool = True) -> Column:
    """The stem of a word. Each step's input is bound once, so the expression grows by steps only."""
    low = F.lower(word) if to_lowercase else word
    out = low
    for step in steps(Columns(), mode):
        out = F.transform(F.array(out), step)[0]
    cases = []
    if mode == MODES[0]:
        forms = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
        cases.append((word.isin(*IRREGULAR), forms[low]))
    if mode != MODES[2]:
        cases.append((F.length(word) <= 2, low))
    cases.append((~F.substring(low, -1, 1).isin(*LAST), low))
    return Columns().choose(cases, out)


def stem_sql(words_sql: str, mode: str = MODES[0], to_lowercase: bool = True) -> str:
    """SQL (word, stem) over a query that gives distinct words as ``word``; a subquery for each step."""
    low = "lower(word)" if to_lowercase else "word"
    sql = f"SELECT word, {low} AS w FROM ({words_sql})"
    for step in steps(Sql(), mode):
        sql = f"SELECT word, {step('w')} AS w FROM ({sql})"
    cases = []
    if mode == MODES[0]:
        names = ", ".join(f"'{x}'" for x in IRREGULAR)
        forms = " ".join(f"WHEN '{a}' THEN '{z}'" for a, z in IRREGULAR.items())
        cases.append((f"word IN ({names})", f"CASE {low} {forms} END"))
    if mode != MODES[2]:
        cases.append(("length(word) <= 2", low))
    return f"SELECT word, {Sql().choose(cases, 'w') if cases else 'w'} AS stem FROM ({sql})"

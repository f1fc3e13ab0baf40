"""Personal information inside free text: find it, and put typed placeholders in its place.

Addresses of mail, numbers and street addresses have forms of their own: a term
of such a form reveals whom it belongs to wherever it stands, so its disclosure
is 1 by form. Names have none: whether ``Page`` or ``Will`` names a person
depends on the corpus. They are found by information-theoretic sanitisation. Over
the whole corpus, co-occurrence counts estimate how strongly a term reveals a
protected person: the share of a term's (capitalised) occurrences that stand in a
slot of a name beside a known name part or a title, and its information in bits
against the share over all terms. Terms above both thresholds disclose; found
ones protect further terms, until no term is added. A title and the word after it
are a term of two words, all of whose occurrences stand in a slot: it discloses
at any count. A mention is a run of disclosing terms that has the form of a
name, and is generalised to its type, the placeholder.

Each text is searched for forms once (:func:`with_forms`); their spans travel
beside the text, and counting and labelling start from them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from logweave.runtime import BROADCAST_ROWS, cut

#: A term discloses if at least this share of its occurrences stands in a name's slot ...
DISCLOSURE = 0.35
#: ... and that tells at least so many bits more than knowing nothing about the term.
BITS = 1.0
#: Occurrences a term is credited with outside names, so that one sighting is not certainty.
PRIOR = 0.5
#: Column with the spans of forms: begin, end and type of one after the other.
FORMS = "__forms"
KINDS = ("email", "phone", "id_number", "address")

PLACEHOLDERS = {
    "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]",
    "address": "[ADDRESS]", "name": "[NAME]",
}

_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62}[\p{L}\p{N}])?"
_LOCAL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+'-]{0,62}[\p{L}\p{N}])?"
_BEFORE = r"(?<![\p{L}\p{N}._%+@/-])"
_DOT = r"(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)"
_EMAIL = regex.compile(
    rf"{_BEFORE}{_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}-]|:[\p{{L}}/~]|@|/)"
)
_EMAIL_BRACKETS = regex.compile(
    rf"{_BEFORE}{_LOCAL}\s?[\[({{<]\s?at\s?[\])}}>]\s?{_LABEL}(?:(?:\.|{_DOT}){_LABEL})+", regex.I
)
#: In every text with a mail spelled with brackets.
_AT_BRACKETS = regex.compile(r"[\[({<]\s?at\s?[\])}>]")
_EMAIL_WORDS = regex.compile(rf"{_BEFORE}{_LOCAL}\sat\s{_LABEL}(?:{_DOT}{_LABEL})+", regex.I)
_NOT_PERSONAL_LOCAL = regex.compile(r"^(?:git|svn|hg)@", regex.I)
_NUMBER_OF = r"(?:\s*(?:no\.?|number|nr\.?|num\.?|n[º°]|id|is|:|#))*\s*"
#: Words of one of which a named number has at least one, in small letters.
_ID_WORDS = ("social", "ssn", "tax", "tin", "national", "nino", "card", "passport", "dni", "nie", "nif", "steuer", "ausweis")
_ID_NAMED = regex.compile(
    rf"(?i:\b(?:social security|ssn|tax(?:\s?id)?|tin|national insurance|nino|identity card|id card|passport|dni|nie|nif|steuer-?id|personalausweis)\b{_NUMBER_OF})"
    r"[A-Z]{0,3}[ -]?\p{N}(?:[ -]?(?:\p{N}|[A-Z](?!\p{Ll}))){5,14}"
)
_ID = regex.compile(
    r"(?<![\p{L}\p{N}.+-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}|\d{2} \d{3} \d{3} \d{3}|[A-CEGHJ-PR-TW-Z][A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]|QQ ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-HJ-NP-TV-Z]|[CFGHJK]\d{2}[CFGHJKLMNPRTVWXYZ]\d{5})(?![\p{L}\p{N}]|-\d|\.\d)"
)
_PHONE = regex.compile(
    r"(?<![\p{L}\p{N}.+/_-])(?:"
    r"(?:\+|00)\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}"
    r"|\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]\d{2,5}){1,3}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|\d{3} \d{3} \d{4}"
    r"|0\d{1,4}(?:[ /-]\d{2,4}){2,5}"
    r"|\d{3}-\d{4}"
    r")(?:\s?(?:ext\.?|x|extension)\s?\d{1,6})?(?![\p{L}\p{N}_]|[.:/-]\d)"
)
_CITY = r"\p{Lu}[\p{L}'’-]+(?: (?:\p{Lu}[\p{L}'’-]+|am|an|der|de|la|sur|upon)){0,2}"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Suite|Unit|Floor|Whg\.?|Appt\.?|Piso|#) ?\p{N}{1,4}\p{L}?|\p{N}{1,3}[ºª°] ?\p{L}{0,4}"
_TAIL = (
    rf"(?:,? ?(?:{_UNIT})(?![\p{{L}}\p{{N}}]))?"
    rf"(?:(?:,\s?|\s)\d{{4,5}}(?:-\d{{4}})? {_CITY}|, ?{_CITY}(?:,? \d{{4,5}}(?:-\d{{4}})?)?)?"
)
_CAP = r"(?:\p{Lu}[\p{L}'’-]*\.?|\d{1,3}(?:st|nd|rd|th))"
_NUMBER_FIRST = regex.compile(
    # 12B Old Mill Avenue
    rf"(?<![\p{{L}}\p{{N}}.#/-])\d{{1,5}}\p{{Lu}}? (?:{_CAP} ){{1,4}}?(?:Street|Lane|Avenue|Road|Row|Close|Drive|Way|Court|Square|Place|Terrace|Crescent|Boulevard|Grove|Gardens|Hill|Bend|Mews|Walk|Parade|(?:St|Ave|Rd|Ln|Dr|Blvd|Ct|Pl|Sq)\b\.?)(?: (?:North|South|East|West))?(?:(?<=\bBend) (?:Road|Lane|Street|Drive))?{_TAIL}"
    # 12 rue des Tilleuls
    rf"|(?<![\p{{L}}\p{{N}}.#/-])\d{{1,5}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours)(?: (?:de|du|des|la|le|les|l['’]\p{{L}}+|d['’]\p{{L}}+)){{0,3}}(?: \p{{Lu}}[\p{{L}}'’-]+){{0,4}}{_TAIL}"
)
# Calle del Molino 12, Via Roma 3, Rua das Flores 8, ul. Długa 5
_KIND_FIRST = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:Calle|Avenida|Plaza|Paseo|Camino|Via|Viale|Piazza|Corso|Rua|Travessa|[Uu]l\.|[Aa]l\.|[Уу]л\.)(?: (?:de|del|della|dei|di|la|las|los|el|da|das|do|dos)){{0,3}}(?: \p{{Lu}}[\p{{L}}'’-]+){{1,4}},? \d{{1,5}}\p{{L}}?(?!\p{{L}}){_TAIL}"
)
# Lindenhofweg 12, Hauptstraße 3, Kerkstraat 9
_KIND_LAST = regex.compile(
    r"(?<![\p{L}\p{N}])(?=\p{Lu})(?:\p{Lu}[\p{L}-]*+\.? (?=\d)(?<=(?:weg|straße|strasse|str\.|gasse|allee|platz|ring|ufer|damm|graben|straat|laan|plein|gracht|kade|dijk) )"
    rf"|(?:Am|An der|An den|Im|In der|Auf der|Zum|Zur|Unter den) \p{{Lu}}[\p{{L}}-]+ )\d{{1,4}} ?\p{{L}}?(?!\p{{L}}){_TAIL}"
)
_TOWN = regex.compile(r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)+$")
#: A placeholder: one identifier in braces. Other things in braces (JSON, say) are text.
_HELD = regex.compile(r"\{\{?\s*[\p{L}_][\p{L}\p{N}_.:-]*\s*\}\}?")
#: Numbers of bank accounts are none of the types; no part of one is a phone number.
_ACCOUNT = regex.compile(r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])")
_DIGIT = regex.compile(r"\p{N}")
#: In every phone number and every number of an identity that stands alone.
_LONG_NUMBER = regex.compile(r"\d[\d\s().+/-]{3,}\d")
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*")
_LETTERS, _INITIAL = regex.compile(r"\p{L}+"), regex.compile(r"\p{Lu}\.")
#: A capitalised word, and what may stand between two that belong to one name.
_CAPITAL = regex.compile(r"(?<![\p{L}\p{M}])(?<![\p{L}\p{M}]['’-])\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*")
_TITLES = frozenset("mr mrs ms miss mx dr prof sir dame herr frau sr sra srta mme mlle".split())
_PARTICLES = frozenset("de del della der den des di da do dos du la le van von zu zum ten ter el al bin ibn".split())
#: What may stand between two parts of one name: a blank, or a dot and a blank after an initial or title.
_BETWEEN = regex.compile(r"[.,]?[ \u00a0](?:(?i:" + "|".join(sorted(_PARTICLES)) + r")[ \u00a0]){0,3}")
#: No such stretch is longer: three particles of at most three letters with their blanks, and two signs.
_FAR = 14
_JOIN, _COMMA = regex.compile(r"\.?[  ]"), regex.compile(r",[  ]")


def forms_of_their_own(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, type)`` of mail addresses, numbers and street addresses, in order, apart."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []

    def take(a: int, b: int, kind: str) -> None:
        """Keep a span unless it meets one that is there already; spans are apart, so its neighbours tell."""
        i = bisect_left(starts, a)
        if (i == len(starts) or b <= starts[i]) and (i == 0 or taken[i - 1][1] <= a):
            starts.insert(i, a)
            taken.insert(i, (a, b, kind))

    if "{" in text:
        for m in _HELD.finditer(text):
            take(*m.span(), "")
    small = text.lower()
    patterns = [("email", _EMAIL)] if "@" in text else []
    if "at" in small and "dot" in small or _AT_BRACKETS.search(small):
        patterns += [("email", _EMAIL_BRACKETS), ("email", _EMAIL_WORDS)]
    if _DIGIT.search(text):
        for m in _ACCOUNT.finditer(text):
            take(*m.span(), "")
        patterns.append(("address", _NUMBER_FIRST, _KIND_FIRST, _KIND_LAST))
        if any(w in small for w in _ID_WORDS):
            patterns.append(("id_number", _ID_NAMED))
        if _LONG_NUMBER.search(text):
            patterns += [("id_number", _ID), ("phone", _PHONE)]
    for kind, *forms in patterns:
        found = [m for pattern in forms for m in pattern.finditer(text)]
        for m in found if len(forms) == 1 else sorted(found, key=lambda m: m.span()):
            a, b = m.span()
            while b > a and text[b - 1] in " -.(":
                b -= 1
            if kind == "email" and _NOT_PERSONAL_LOCAL.match(m.group()):
                continue
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in m.group()) <= 20:
                continue
            take(a, b, kind)
    return [t for t in taken if t[2]]


@F.pandas_udf(ArrayType(IntegerType()))
def _forms_column(texts: pd.Series) -> pd.Series:
    def spans(text):
        return [x for a, b, kind in forms_of_their_own(text) for x in (a, b, KINDS.index(kind))] if text else []

    return pd.Series([spans(t) for t in texts], dtype=object)


def with_forms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the spans of all forms in ``text`` in the column ``FORMS``, for the functions below."""
    return df if FORMS in df.columns else df.withColumn(FORMS, _forms_column(text))


def _spans(forms) -> list[tuple[int, int, str]]:
    flat = [int(x) for x in forms] if forms is not None else []
    return [(flat[i], flat[i + 1], KINDS[flat[i + 2]]) for i in range(0, len(flat), 3)]


def masked(text: str, taken: list[tuple[int, int, str]]) -> str:
    """``text`` with NULs in the place of taken spans and placeholders."""
    out, at = [], 0
    for a, b, _ in taken:
        out += [text[at:a], "\x00" * (b - a)]
        at = b
    out = "".join([*out, text[at:]]) if taken else text
    return _HELD.sub(lambda m: "\x00" * len(m.group()), out) if "{" in out else out


def key_of(word: str) -> str:
    """A name part in one spelling: no case, one apostrophe, without a possessive s."""
    w = word.casefold().replace("’", "'")
    return w[:-2] if w.endswith("'s") and len(w) > 3 else w


def family_key(part: str) -> str:
    """The last word of a family name; particles before it do not tell names apart."""
    return key_of(part.split()[-1])


class Words:
    """The words of a text outside mentions with forms of their own, and how they adjoin."""

    def __init__(self, text: str, taken: list[tuple[int, int, str]]):
        body = masked(text, taken)
        self.spans = [m.span() for m in _TOKEN.finditer(body)]
        self.raw = [body[a:b] for a, b in self.spans]
        self.key = [key_of(w) for w in self.raw]
        self.cap = [w[0].isupper() for w in self.raw]
        n = len(self.raw)
        self.gap = [body[self.spans[i][1] : self.spans[i + 1][0]] if i + 1 < n else "\n" for i in range(n)]
        self.initial = [len(w) == 1 and c and g.startswith(".") for w, c, g in zip(self.raw, self.cap, self.gap, strict=True)]
        self.title = [k in _TITLES and c and len(k) > 1 for k, c in zip(self.key, self.cap, strict=True)]

    def joined(self, i: int) -> bool:
        """Whether word ``i`` and the next can be parts of one name side by side."""
        g = self.gap[i]
        if self.initial[i] or self.title[i]:
            return bool(_JOIN.fullmatch(g))
        return g in (" ", " ") and not self.raw[i].endswith(("'s", "’s"))

    def past_particles(self, i: int) -> int:
        """Index of the word after particles at ``i``; ``i`` itself if there are none."""
        j = i
        while j < len(self.raw) and j - i < 3 and self.key[j] in _PARTICLES and self.joined(j):
            j += 1
        return j

    def past_initials(self, i: int) -> int:
        j = i
        while j < len(self.raw) and j - i < 3 and self.initial[j] and self.joined(j):
            j += 1
        return j

    def evidence(self) -> Iterator[tuple[str, str, str]]:
        """``(pattern, a, b)`` of neighbours that could be parts of one name.

        ``gf``: a given and then a family name, initials and particles between them
        left out; ``fg``: the same the other way round with a comma; ``tf``: a title and then ``b``.
        """
        for i in range(len(self.raw)):
            if not self.cap[i] or self.initial[i] or self.key[i] in _PARTICLES:
                continue
            if self.title[i]:
                if self.joined(i):
                    j = self.past_particles(self.past_initials(i + 1))
                    if j < len(self.raw) and self.cap[j] and not self.initial[j]:
                        yield "tf", "", self.key[j]
                continue
            if self.joined(i):
                j = self.past_particles(self.past_initials(i + 1))
                if j < len(self.raw) and self.cap[j] and not self.initial[j] and not self.title[j]:
                    yield "gf", self.key[i], self.key[j]
            elif _COMMA.fullmatch(self.gap[i]) and self.cap[i + 1] and not self.initial[i + 1]:
                yield "fg", self.key[i], self.key[i + 1]

    def mentions(self, given, family) -> list[tuple[int, int]]:
        """Spans of names. ``given`` and ``family`` tell whether a key discloses as such a part."""
        out, i, n = [], 0, len(self.raw)

        def fam(j: int, small: bool = False) -> int:
            """Index of the last word of a family name that starts at ``j``, or -1."""
            k = self.past_particles(j)
            if k < n and (self.cap[k] or small) and not self.initial[k] and family(self.key[k]):
                return k
            return -1

        while i < n:
            end = -1
            if self.title[i] and self.joined(i):
                j = i + 1
                if j < n and self.cap[j] and given(self.key[j]) and self.joined(j):
                    end = fam(self.past_initials(j + 1))
                if end < 0:
                    end = fam(self.past_initials(j))
                if end < 0:  # a title reveals whoever it stands before, known or not
                    k = self.past_particles(self.past_initials(j))
                    if k < n and self.cap[k] and not self.initial[k]:
                        end = k
            elif self.initial[i]:
                j = self.past_initials(i)
                if j > i:
                    end = fam(j)
            elif given(self.key[i]) and self.joined(i):
                j = self.past_initials(i + 1)
                end = fam(j, small=not self.cap[i])
                if end >= 0 and not self.cap[i] and (self.cap[end] or j > i + 1):
                    end = -1  # small letters all through, or capitals
            if end < 0 and (self.cap[i] or self.key[i] in _PARTICLES):
                k = fam(i)
                if k >= 0 and k + 1 < n and _COMMA.fullmatch(self.gap[k]) and self.cap[k + 1] and given(self.key[k + 1]):
                    end = k + 1
                    while end + 1 < n and self.joined(end) and self.initial[end + 1]:
                        end += 1
            if end >= 0:
                b = self.spans[end][1]
                if self.raw[end].endswith(("'s", "’s")) and len(self.raw[end]) > 3:
                    b -= 2
                if self.initial[end]:
                    b += 1
                out.append((self.spans[i][0], b))
                i = end + 1
            else:
                i += 1
        return out


def _city_end(text: str, a: int, b: int, given) -> int:
    """Where an address ends if what looks like more of its town is a person's given name."""
    tail = _TOWN.search(text, a, b)
    if tail:
        for m in list(_TOKEN.finditer(text, tail.start(), b))[1:]:
            if given(key_of(m.group())) or key_of(m.group()) in _TITLES:
                return m.start() - 1
    return b


class Lexicon:
    """Keys that disclose as a given or family name."""

    def __init__(self, given, family):
        self.given, self.family = frozenset(given), frozenset(family)
        heads = lambda keys: {m.group() for k in keys for m in [_LETTERS.search(k)] if m}
        self._given, self._family = heads(self.given), heads(self.family)

    def may_name(self, text: str, address: bool) -> bool:
        """Whether a text can hold a name: each has a title, or a family name beside a given name or an initial.

        In a text with an address a given name may also end its town.
        """
        letters = set(_LETTERS.findall(text.casefold()))
        if not _TITLES.isdisjoint(letters):
            return True
        given = not self._given.isdisjoint(letters)
        if address and given:
            return True
        return not self._family.isdisjoint(letters) and (given or _INITIAL.search(text) is not None)


def find_mentions(text: str | None, lexicon: Lexicon, forms: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    """All mentions in a text: ``(start, end, type)`` in order. Null and empty texts have none.

    ``forms`` are those of :func:`forms_of_their_own`, if they are known already.
    """
    if not text:
        return []
    taken = forms_of_their_own(text) if forms is None else forms
    if not lexicon.may_name(text, any(k == "address" for _, _, k in taken)):
        return taken
    given, family = lexicon.given.__contains__, lexicon.family.__contains__
    taken = [(a, _city_end(text, a, b, given) if k == "address" else b, k) for a, b, k in taken]
    names = [(a, b, "name") for a, b in Words(text, taken).mentions(given, family)]
    return sorted(taken + names)


def sanitise(text: str, mentions: list[tuple[int, int, str]]) -> str:
    """The text with each mention's placeholder in its place and otherwise as it was."""
    out, at = [], 0
    for a, b, kind in mentions:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def neighbours(text: str, forms: list[tuple[int, int, str]]) -> Iterator[tuple[str, str, str]]:
    """``("word", key, "")`` of each capitalised word, and the :meth:`Words.evidence` of those that adjoin.

    Only capitalised words take part, so only stretches of them are read word by word.
    """
    body = masked(text, forms)
    first = last = None
    for m in _CAPITAL.finditer(body):
        a, b = m.span()
        if not (b == a + 1 and body[b : b + 1] == "."):
            yield "word", key_of(m.group()), ""
        if last is not None and a - last <= _FAR and _BETWEEN.fullmatch(body, last, a):
            last = b
            continue
        if first is not None and last > stop:
            yield from Words(body[first : last + 2], []).evidence()
        first, last, stop = a, b, b
    if first is not None and last > stop:
        yield from Words(body[first : last + 2], []).evidence()


def _count_neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one partition's neighbours and words, summed before they leave it."""
    counts: Counter = Counter()

    def rows() -> pd.DataFrame:
        frame = pd.DataFrame([(*k, v) for k, v in counts.items()], columns=["pattern", "a", "b", "n"])
        counts.clear()
        return frame.astype({"n": "int64"})

    for pdf in batches:
        for text, forms in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
            if text:
                counts.update(neighbours(text, _spans(forms)))
        if len(counts) > 500_000:
            yield rows()
    if counts:
        yield rows()


def _seed_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(family_key(p) if k == "family" else key_of(p.strip()), k) for p, k in zip(pdf["name_part"], pdf["kind"], strict=True) if p.strip()]
        yield pd.DataFrame(rows, columns=["term", "kind"])


def learn_names(texts: DataFrame, text: str, parts: DataFrame) -> DataFrame:
    """``(term, kind, disclosure, bits)``: terms of the corpus that disclose persons.

    ``parts`` is the table (name_part, kind) of some known names, the seeds (they
    come back with disclosure 1). Every text of the corpus is counted. Found terms
    are clues to further ones; each round joins only the terms found in the last
    one, and the rounds end when none is added. A term once found stays.
    """
    counted = cut(
        with_forms(texts, text).select(text, FORMS)
        .mapInPandas(_count_neighbours, "pattern string, a string, b string, n long")
        .groupBy("pattern", "a", "b").agg(F.sum("n").alias("n"))
    )
    total = counted.where("pattern = 'word'").select(F.col("a").alias("term"), F.col("n").alias("total"))
    every = total.agg(F.sum("total").alias("every"))  # one row

    def clue(pattern: str, source: str, source_kind: str, term: str, kind: str) -> DataFrame:
        return counted.where(F.col("pattern") == pattern).select(
            F.col(source).alias("source"), F.lit(source_kind).alias("source_kind"), F.col(term).alias("term"), F.lit(kind).alias("kind"), "n"
        )

    clues = cut(
        clue("tf", "a", "title", "b", "family")
        .unionByName(clue("gf", "a", "given", "b", "family")).unionByName(clue("fg", "b", "given", "a", "family"))
        .unionByName(clue("gf", "b", "family", "a", "given")).unionByName(clue("fg", "a", "family", "b", "given"))
        .join(total, "term")
    )
    seeds = parts.where("name_part is not null and kind in ('given', 'family')").select("name_part", "kind")
    known = seeds.mapInPandas(_seed_keys, "term string, kind string").distinct()
    lexicon = cut(known.withColumns({"disclosure": F.lit(1.0), "bits": F.lit(None).cast("double")}))
    new = lexicon.select("term", "kind")
    evidence = clues.where("source_kind = 'title'").groupBy("term", "kind").agg(F.sum("n").alias("n"), F.max("total").alias("total"))
    while True:
        found = clues.join(new.toDF("source", "source_kind"), ["source", "source_kind"]).select("term", "kind", "n", "total")
        evidence = cut(evidence.unionByName(found).groupBy("term", "kind").agg(F.sum("n").alias("n"), F.max("total").alias("total")))
        base = evidence.groupBy("kind").agg(F.sum("n").alias("slots")).crossJoin(F.broadcast(every))  # two rows
        share = F.col("n") / (F.col("total") + PRIOR)
        scored = evidence.join(F.broadcast(base), "kind").withColumns({
            "disclosure": share, "bits": F.log2(share * F.col("every") / F.col("slots")),
        })
        learned = scored.where((F.col("disclosure") >= DISCLOSURE) & (F.col("bits") >= BITS))
        learned = cut(learned.join(lexicon.select("term", "kind"), ["term", "kind"], "left_anti").select(*lexicon.columns))
        if learned.isEmpty():
            return lexicon
        lexicon, new = cut(lexicon.unionByName(learned)), learned.select("term", "kind")


def all_keys(text: str, taken: list[tuple[int, int, str]]) -> set[str]:
    """Every key :func:`find_mentions` may look up in a text: of its words as they stand, and of those left by its masks."""
    keys = set(Words(text, taken).key) | {key_of(m.group()) for m in _TOKEN.finditer(text)}
    for a, b, _ in taken:
        keys.update(key_of(m.group()) for m in _TOKEN.finditer(text, a, b))
    return keys


def _mentions_with(df: DataFrame, text: str, lexicon: DataFrame, emit, schema: str) -> DataFrame:
    """Run ``emit(row values before the text, text, mentions)`` over ``df`` (text and forms last).

    The lexicon goes to the workers if it has at most BROADCAST_ROWS rows. Beyond,
    each text gets the entries for its own words by a join on the term.
    """
    size = lexicon.count()
    columns = df.columns
    if size <= BROADCAST_ROWS:
        terms = {"given": set(), "family": set()}
        for r in lexicon.select("term", "kind").collect():
            terms[r["kind"]].add(r["term"])
        shared = df.sparkSession.sparkContext.broadcast(Lexicon(terms["given"], terms["family"]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = zip(*[pdf[c] for c in columns], strict=True)
                yield emit([(r[:-2], r[-2], find_mentions(r[-2], shared.value, _spans(r[-1]))) for r in rows])

        return df.mapInPandas(run, schema)

    numbered = cut(df.withColumn("__row", F.monotonically_increasing_id()))

    def keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["__row"], pdf[text], pdf[FORMS], strict=True)
            out = [(number, k) for number, body, forms in rows if body for k in all_keys(body, _spans(forms))]
            yield pd.DataFrame(out, columns=["__row", "term"]).astype({"__row": "int64"})

    asked = numbered.select("__row", text, FORMS).mapInPandas(keys_of, "__row long, term string")
    entries = asked.join(lexicon.select("term", "kind"), "term").groupBy("__row").agg(
        F.collect_set(F.struct("kind", "term")).alias("__entries")  # no more than the text has words
    )
    rows = numbered.join(entries, "__row", "left").select(*columns, "__entries")

    def run_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *r, entries in zip(*[pdf[c] for c in [*columns, "__entries"]], strict=True):
                own = {"given": [], "family": []}
                for e in entries if entries is not None else ():
                    own[e["kind"]].append(e["term"])
                out.append((tuple(r[:-2]), r[-2], find_mentions(r[-2], Lexicon(own["given"], own["family"]), _spans(r[-1]))))
            yield emit(out)

    return rows.mapInPandas(run_own, schema)


def mention_table(df: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """``keys, pii_type, occurrence, begin, end, mention`` of every mention in every text.

    ``occurrence`` counts the mentions of a type in a text from 1. Null, blank and
    very long texts are read whole. Repeated rows are not removed here.
    """
    columns = [*keys, "pii_type", "occurrence", "begin", "end", "mention"]

    def emit(found) -> pd.DataFrame:
        out = []
        for key, body, mentions in found:
            seen: Counter = Counter()
            for a, b, kind in mentions:
                seen[kind] += 1
                out.append((*key, kind, seen[kind], a, b, body[a:b]))
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({"occurrence": "int32", "begin": "int32", "end": "int32"})

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, pii_type string, occurrence int, begin int, end int, mention string"
    rows = with_forms(df, text).select(*keys, text, FORMS).where(F.col(text).isNotNull())
    return _mentions_with(rows, text, lexicon, emit, schema)


def sanitised_table(df: DataFrame, keys: list[str], text: str, lexicon: DataFrame) -> DataFrame:
    """``keys, text`` with placeholders; a null text stays null."""

    def emit(found) -> pd.DataFrame:
        out = [(*key, sanitise(body, mentions) if body else body) for key, body, mentions in found]
        return pd.DataFrame(out, columns=[*keys, text])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return _mentions_with(with_forms(df, text).select(*keys, text, FORMS), text, lexicon, emit, f"{fields}, `{text}` string")

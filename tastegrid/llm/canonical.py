"""Freely typed values mapped to the entries of a reference list.

The entries and their aliases are paths of one trie. A typed value is searched along all paths at once by an
automaton that accepts whatever lies within a distance that depends on the length; subtrees that no completion can
bring back within it are left. The distance counts letters changed, left out, put in or swapped with the next.
An entry that stands in a value as whole words yields to a longer one that the words around it spell with a typo.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.blanks import is_blank

#: The reference list is searched from every executor's memory; a longer one is refused.
MOST_ENTRIES = 100_000
#: Typed values whose result a Python worker remembers; then it forgets them all.
REMEMBERED_VALUES = 500_000

# Further names of the entries, by field and canonical value.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "coffee_origin_country": {
        "Ethiopia": ("Éthiopie", "Etiopía", "Äthiopien", "Ethiopa", "Abyssinia"),
        "Colombia": ("Columbia", "Colombie", "Kolumbien", "Colômbia"),
        "Kenya": ("Kenia", "Quênia"),
        "Guatemala": ("Guat.", "Guatamala"),
        "Panama": ("Panamá", "Panamà"),
        "Costa Rica": ("C. Rica", "CostaRica"),
        "Indonesia": ("Indonesien", "Indonésie"),
        "Brazil": ("Brasil", "Brasilien", "Brésil"),
        "El Salvador": ("El Salv.", "Salvador, El", "Salvador"),
        "Honduras": ("Hond.",),
        "Rwanda": ("Ruanda", "Rwandan Republic"),
        "Burundi": ("Burundy",),
        "Nicaragua": ("Nica.", "Nicarágua"),
        "Peru": ("Perú", "Pérou"),
        "Mexico": ("México", "Méjico", "Mexiko", "Mexique"),
        "Papua New Guinea": ("PNG", "P.N.G.", "Papua N. Guinea", "New Guinea, Papua", "Papua Neuguinea", "New Guinea"),
        "Yemen": ("Jemen", "Yémen", "Al-Yaman"),
        "Tanzania": ("Tansania", "Tanzanie", "Tanganyika"),
        "Uganda": ("Ouganda",),
        "Ecuador": ("Ekuador", "Équateur"),
        "Bolivia": ("Bolivien", "Bolivie"),
        "Thailand": ("Tailandia", "Thaïlande", "Siam"),
        "Vietnam": ("Viet Nam", "Việt Nam"),
        "China": ("PRC", "P.R. China", "Chine", "People's Republic of China"),
        "Taiwan": ("Chinese Taipei", "Formosa"),
        "India": ("Bharat", "Indien", "Inde"),
        "Myanmar": ("Burma", "Birmanie", "Birma"),
        "Dominican Republic": ("Dom. Rep.", "Dominican Rep", "República Dominicana"),
        "Dominica": ("Commonwealth of Dominica",),
        "Haiti": ("Haïti", "Hayti"),
        "Jamaica": ("Jamaika", "Jamaïque"),
        "Cuba": ("Kuba",),
        "Philippines": ("Filipinas", "Pilipinas", "Philippinen"),
        "Laos": ("Lao P.D.R.", "Lao PDR", "Lao"),
        "Nepal": ("Népal",),
        "Malawi": ("Malaui",),
        "Mali": ("Rép. du Mali",),
        "Zambia": ("Sambia", "Zambie"),
        "Zimbabwe": ("Simbabwe",),
        "Cameroon": ("Cameroun", "Kamerun", "Camerún"),
        "Democratic Republic of the Congo": ("DR Congo", "D.R. Congo", "RD Congo", "DRC", "Congo-Kinshasa", "Dem. Rep. of the Congo", "Zaire"),
        "Republic of the Congo": ("Congo Republic", "Congo-Brazzaville", "Rep. of the Congo", "Congo, Republic of the"),
        "Ivory Coast": ("Côte d'Ivoire", "Cote d'Ivoire", "Elfenbeinküste"),
        "Guinea": ("Guinée", "Guinea-Conakry"),
        "Equatorial Guinea": ("Eq. Guinea", "Guinea Ecuatorial", "Guinée équatoriale"),
        "Nigeria": ("Nigéria",),
        "Madagascar": ("Madagaskar",),
        "Timor-Leste": ("East Timor", "Timor Leste", "Timor Lorosae"),
    },
    "price_currency": {
        "USD": ("US", "US $", "$ US", "USD $", "$", "US dollar", "American dollar", "dollars US", "United States dollar"),
        "TWD": ("NT", "NT $", "NTD", "NT dollar", "Taiwan dollar", "Taiwanese dollar"),
        "HKD": ("HK", "HK $", "HK dollar", "Hongkong dollar"),
        "CAD": ("C $", "CA $", "CAD $", "CDN $", "CDN", "Can dollar", "Can $"),
        "AUD": ("A $", "AU $", "AUD $", "Aus dollar", "Aust dollar", "Aussie dollar"),
        "CNY": ("RMB", "yuan", "renminbi", "Chinese yuan renminbi", "元", "CN ¥", "CNH"),
        "JPY": ("yen", "JP ¥", "¥", "円", "YEN"),
        "GBP": ("£", "#", "stg", "sterling", "British pound", "pound", "UK pound", "quid", "UK £"),
        "EUR": ("€", "E", "euro"),
        "MXN": ("peso", "MXN $", "MX $", "Mex $"),
        "MYR": ("RM", "ringgit"),
        "KRW": ("won", "₩", "Korean won"),
        "THB": ("baht", "฿"),
        "CHF": ("Sfr", "SFr.", "Fr", "franc", "Franken"),
        "SEK": ("kr", "krona", "kronor", "Swedish kronor"),
        "IDR": ("Rp", "rupiah"),
    },
}

# Three-letter codes of the countries, which count only as a whole part of a value.
COUNTRY_CODES = {
    "Ethiopia": "ETH", "Colombia": "COL", "Kenya": "KEN", "Guatemala": "GTM", "Panama": "PAN", "Costa Rica": "CRI",
    "Indonesia": "IDN", "Brazil": "BRA", "El Salvador": "SLV", "Honduras": "HND", "Rwanda": "RWA", "Burundi": "BDI",
    "Nicaragua": "NIC", "Peru": "PER", "Mexico": "MEX", "Papua New Guinea": "PNG", "Yemen": "YEM", "Tanzania": "TZA",
    "Uganda": "UGA", "Ecuador": "ECU", "Bolivia": "BOL", "Thailand": "THA", "Vietnam": "VNM", "China": "CHN",
    "Taiwan": "TWN", "India": "IND", "Myanmar": "MMR", "Dominican Republic": "DOM", "Dominica": "DMA", "Haiti": "HTI",
    "Jamaica": "JAM", "Cuba": "CUB", "Philippines": "PHL", "Laos": "LAO", "Nepal": "NPL", "Malawi": "MWI",
    "Mali": "MLI", "Zambia": "ZMB", "Zimbabwe": "ZWE", "Cameroon": "CMR", "Democratic Republic of the Congo": "COD",
    "Republic of the Congo": "COG", "Ivory Coast": "CIV", "Guinea": "GIN", "Equatorial Guinea": "GNQ", "Niger": "NER",
    "Nigeria": "NGA", "Angola": "AGO", "Madagascar": "MDG", "Timor-Leste": "TLS",
}

_SIGNS = "$£€¥₩฿円元#¢"


def folded(text: str) -> str:
    """Without accents, dots and apostrophes, in lower case, signs of currencies as words, everything else blank."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    out = []
    for c in plain:
        if c in _SIGNS:
            out.append(f" {c} ")
        elif c.isalnum():
            out.append(c)
        elif c in ".'’`´" or unicodedata.combining(c):
            continue
        else:
            out.append(" ")
    return " ".join("".join(out).replace("ß", "ss").split())


def allowed_distance(length: int) -> int:
    """How far a typed name of so many letters may lie from an entry's own name."""
    return 0 if length <= 3 else 1 if length == 4 else 2


class Trie:
    """Names as paths of letters; a search returns every entry within a distance."""

    def __init__(self) -> None:
        self._root: dict = {}

    def add(self, name: str, entry: int, most: int, kind: str = "") -> None:
        """``most``: the distance at which the name may still be met; ``kind``: the searches that it is for."""
        node = self._root
        for c in name:
            node = node.setdefault(c, {})
        node.setdefault("", []).append((entry, most, name, kind))

    def search(self, typed: str, distance: int, kind: str = "") -> list[tuple[int, int, str]]:
        """(distance, entry, name) of every path within ``distance`` of ``typed``.

        The automaton's state is a band: the distance of the path so far, of i letters, to the prefixes of ``typed`` of
        i - distance to i + distance letters, cut off above the limit. A state with nothing below the limit accepts no
        completion. A step costs as many cells as the band has, however long the text is.
        """
        found: list[tuple[int, int, str]] = []
        n, top = len(typed), distance + 1
        start = tuple(j if 0 <= j <= n else top for j in range(-distance, distance + 1))
        stack = [(self._root, 0, start, None, "")]
        while stack:
            node, i, band, before, letter = stack.pop()
            end = n - i + distance
            if 0 <= end <= 2 * distance and band[end] <= distance:
                found += [(band[end], entry, name) for entry, most, name, of in node.get("", ()) if of == kind and band[end] <= most]
            for c, child in node.items():
                if c:
                    new = self._step(typed, i + 1, distance, band, before, letter, c)
                    if min(new) <= distance:
                        stack.append((child, i + 1, new, band, c))
        return found

    @staticmethod
    def _step(typed: str, i: int, distance: int, band: tuple, before: tuple | None, letter: str, c: str) -> tuple:
        """The band after the path's i-th letter ``c``, which comes after ``letter``."""
        top, new = distance + 1, []
        for k in range(2 * distance + 1):
            j = i - distance + k
            if not 0 <= j <= len(typed):
                new.append(top)
                continue
            cost = top
            if j:
                t = typed[j - 1]
                cost = band[k] if t == c else band[k] + 1
                if before is not None and j > 1 and t == letter and typed[j - 2] == c:
                    cost = min(cost, before[k] + 1)
            if k:
                cost = min(cost, new[k - 1] + 1)
            if k < 2 * distance:
                cost = min(cost, band[k + 1] + 1)
            new.append(min(cost, top))
        return tuple(new)


#: Kinds of paths: names that count within a longer text, and such as count only as a whole part of one.
_INSIDE, _PART = "inside", "part"


class CanonicalMatcher:
    """Typed values of one field to reference ids."""

    def __init__(self, field: str, entries: list[tuple[int, str, str | None]]) -> None:
        """``entries``: ref_id, canonical, full name or None."""
        inside: dict[str, int] = {}  # names that count within a longer text
        part: dict[str, int] = {}  # names that count only as a whole part
        self._names: list[tuple[str, int, int]] = []  # with the distance at which each may still be met
        self._trie = Trie()
        self._around: dict[str, Trie] = {}
        self._known: dict[str, int] = {}
        self.canonical = {canonical for _, canonical, _ in entries}
        aliases = ALIASES.get(field, {})
        for ref, canonical, full in entries:
            for name in [n for n in (canonical, full) if n]:
                key = folded(name)
                for form in {key, key + "s", key + "es"} if full else {key}:
                    inside[form] = ref
                self._names.append((key, ref, allowed_distance(len(key))))
        for ref, canonical, _ in entries:
            for alias in aliases.get(canonical, ()):
                key = folded(alias)
                for form in {key, key + "s"}:
                    (inside if len(key) > 2 or not key.isascii() else part).setdefault(form, ref)
                if len(key) >= 5:
                    self._names.append((key, ref, 1))
            if field == "coffee_origin_country" and canonical in COUNTRY_CODES:
                part.setdefault(COUNTRY_CODES[canonical].lower(), ref)
        for name in self._names:
            self._trie.add(*name)
        for kind, forms in ((_INSIDE, inside), (_PART, part)):
            for form, ref in forms.items():
                self._trie.add(form, ref, 0, kind)
        self._longest = max((len(n.split()) for n in inside), default=1)
        self._letters = max(map(len, inside), default=0)

    def _spelt(self, text: str, *kinds: str) -> int:
        """The entry of which a text is a name letter for letter, 0 if none."""
        return next((ref for kind in kinds for _, ref, _ in self._trie.search(text, 0, kind)), 0)

    def match(self, value: str) -> int:
        """The ref_id that a value means, 0 if none."""
        ref = self._known.get(value)
        if ref is None:
            if len(self._known) >= REMEMBERED_VALUES:
                self._known.clear()
            ref = self._known[value] = self._match(value)
        return ref

    def _match(self, value: str) -> int:
        whole = folded(value)
        parts = [p for p in (folded(x) for x in _parts(value)) if p]
        named = next(((ref, text) for text in [whole, *parts] if (ref := self._spelt(text, _INSIDE, _PART))), None)
        named = named or self._within(whole)
        if named:
            return self._longer(whole, *named)
        for text in [whole, *(p for p in parts if p != whole)]:
            ref = self._near(text)
            if ref:
                return ref
        return 0

    def _within(self, text: str) -> tuple[int, str] | None:
        """The one entry that the words of a text name, longer names first, with its name; None for none and for several."""
        words, used, refs = text.split(), set(), {}
        for n in range(min(self._longest, len(words)), 0, -1):
            for i in range(len(words) - n + 1):
                span = range(i, i + n)
                name = " ".join(words[i : i + n])
                ref = 0 if used.intersection(span) else self._spelt(name, _INSIDE)
                if ref:
                    used.update(span)
                    refs.setdefault(ref, name)
        return refs.popitem() if len(refs) == 1 else None

    def _longer(self, text: str, ref: int, name: str) -> int:
        """The entry of the name that words of a text spell, or that of a longer one that they spell with words next
        to them: one which, after what its distance takes off, still has more letters."""
        longer = self._around.get(name)
        if longer is None:
            longer = self._around[name] = self._that_may_hold(name)
        words, inner = text.split(), name.split()
        most, best = len(inner) + self._longest, (len(name), 0, ref)
        for at in [i for i in range(len(words) - len(inner) + 1) if words[i : i + len(inner)] == inner]:
            for i in range(max(0, at + len(inner) - most), at + 1):
                for j in range(at + len(inner), min(len(words), i + most) + 1):
                    around = " ".join(words[i:j])
                    if j - i > len(inner) and len(around) <= self._letters + 2:
                        for d, entry, found in longer.search(around, allowed_distance(len(around) + 1)):
                            best = max(best, (len(found) - d, -entry, entry)) if len(found) - d > len(name) else best
        return best[2]

    def _that_may_hold(self, name: str) -> Trie:
        """The longer names that lack no more letters of a name than their distance allows: no other
        one lies within its distance of a text that has the name in it."""
        out, letters = Trie(), Counter(name)
        for key, entry, most in self._names:
            if len(key) > len(name) and (letters - Counter(key)).total() <= most:
                out.add(key, entry, most)
        return out

    def _near(self, text: str) -> int:
        """The nearest entry within the distance; of equally near ones that which needs no letter put in but a doubled
        one, then the longer name."""
        hits = self._trie.search(text, allowed_distance(len(text) + 1))
        if not hits:
            return 0
        nearest = min(d for d, _, _ in hits)
        return min((len(_undoubled(text)) > len(_undoubled(name)), -len(name), entry) for d, entry, name in hits if d == nearest)[2]


def _undoubled(text: str) -> str:
    return "".join(c for i, c in enumerate(text) if i == 0 or text[i - 1] != c)


def _parts(value: str) -> list[str]:
    out, part = [], []
    for c in value:
        if c in ",;/()":
            out.append("".join(part))
            part = []
        else:
            part.append(c)
    return [*out, "".join(part)]


def canonical_references(values: DataFrame, reference: DataFrame, fields: list[str], id_column: str) -> DataFrame:
    """record, field_name, value, ref_id: the entry meant by each non-blank value that is not itself canonical.

    ``reference``: ref_id, field_name, canonical, full_name. ref_id is 0 where no entry is meant. Equal rows count
    once; nulls and blanks give no row, nor do rows without an id; an empty reference list matches nothing; further
    columns are ignored. Values are searched where they lie and remembered, so that a value of any frequency is
    searched once a worker and nothing is shuffled but the result's duplicates.
    """
    rows = reference.where("ref_id is not null and canonical is not null").select("ref_id", "field_name", "canonical", "full_name").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the reference list has more than {MOST_ENTRIES} entries")
    entries = {f: sorted((r.ref_id, r.canonical, r.full_name) for r in rows if r.field_name == f) for f in fields}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {f: CanonicalMatcher(f, e) for f, e in entries.items()}
        for batch in batches:
            keep, refs = [], []
            for k, (field, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                matcher = matchers[field]
                if value not in matcher.canonical:
                    keep.append(k)
                    refs.append(matcher.match(value))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(refs, pa.int64())], ["record", "field_name", "value", "ref_id"])

    typed = values.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("record"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])),
    )
    typed = typed.where(~is_blank(F.col("value")))
    kind = typed.schema["record"].dataType.simpleString()
    return typed.mapInArrow(match, f"record {kind}, field_name string, value string, ref_id bigint").distinct()


def unmatched_values(found: DataFrame) -> DataFrame:
    """field_name, value, records: the values without an entry, with the number of records that have them."""
    return found.where("ref_id = 0").groupBy("field_name", "value").agg(F.count_distinct("record").alias("records"))

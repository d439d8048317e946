"""Names typed by people: what is left of a spelling when its noise is gone, and how near two spellings are."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Words that say little about which company it is.
GENERIC = frozenset(
    "coffee coffees coffe cofee coff cof cafe caffe kaffee espresso roaster roasters roasting roastery roasterie rstrs rstr"
    " rstg company co lab labs works house specialty spec bean beans the of and at".split()
)
LEGAL = frozenset("inc incorporated llc ltd limited corp gmbh pty plc bv ab as sdn bhd kk".split())

# Abbreviations and nicknames, written out.
WRITTEN_OUT = {
    "bros": "brothers", "bro": "brothers", "sis": "sisters", "srs": "sisters", "mtn": "mountain", "mt": "mountain", "mntn": "mountain",
    "gdn": "garden", "gdns": "garden", "grdn": "garden", "jct": "junction", "jctn": "junction", "stn": "station", "sta": "station",
    "hbr": "harbor", "harbour": "harbor", "isl": "island", "is": "island", "vly": "valley", "vlly": "valley", "rvr": "river",
    "brdg": "bridge", "brg": "bridge", "crk": "creek", "frst": "forest", "fst": "forest", "mkt": "market", "mrkt": "market",
    "orch": "orchard", "orchd": "orchard", "pr": "prairie", "qry": "quarry", "rdg": "ridge", "smt": "summit", "smmt": "summit",
    "ter": "terrace", "terr": "terrace", "trrc": "terrace", "fdry": "foundry", "lghths": "lighthouse", "ml": "mill", "mdw": "meadow",
    "lgn": "lagoon", "cyn": "canyon", "cnyn": "canyon", "ancr": "anchor", "cmps": "compass", "pnr": "pioneer",
    "mike": "michael", "mick": "michael", "sam": "samuel", "sammy": "samuel", "kate": "katherine", "kathy": "katherine", "katie": "katherine",
    "bob": "robert", "rob": "robert", "bobby": "robert", "ben": "benjamin", "benny": "benjamin", "liz": "elizabeth", "beth": "elizabeth",
    "betty": "elizabeth", "bill": "william", "will": "william", "billy": "william", "alex": "alexander", "al": "alexander", "sandy": "alexander",
    "pat": "patricia", "patty": "patricia", "trish": "patricia", "ed": "edward", "eddie": "edward", "ned": "edward",  "ted": "theodore", "theo": "theodore",
    "teddy": "theodore", "fred": "frederick", "freddy": "frederick", "jo": "josephine", "josie": "josephine", "toni": "antonia", "tonya": "antonia",
    "meg": "margaret", "peg": "margaret", "maggie": "margaret", "peggy": "margaret", "lottie": "charlotte", "charlie": "charlotte", "jim": "james", "tom": "thomas",
    "dave": "david", "dan": "daniel", "joe": "joseph", "nick": "nicholas", "steve": "stephen", "chris": "christopher", "matt": "matthew",
    "andy": "andrew", "tony": "anthony", "jen": "jennifer", "jenny": "jennifer", "sue": "susan", "vicky": "victoria", "becky": "rebecca",
}

# Countries and their codes as locations have them.
COUNTRIES = {
    "united states": "us", "united states of america": "us", "usa": "us", "us": "us", "united kingdom": "gb", "uk": "gb", "gb": "gb",
    "great britain": "gb", "england": "gb", "canada": "ca", "ca": "ca", "germany": "de", "deutschland": "de", "de": "de", "japan": "jp", "jp": "jp",
    "taiwan": "tw", "tw": "tw", "mexico": "mx", "mx": "mx", "norway": "no", "no": "no", "malaysia": "my", "my": "my", "australia": "au", "au": "au",
    "france": "fr", "fr": "fr", "italy": "it", "it": "it", "spain": "es", "es": "es", "sweden": "se", "se": "se", "denmark": "dk", "dk": "dk",
    "china": "cn", "cn": "cn", "hong kong": "hk", "hk": "hk", "south korea": "kr", "korea": "kr", "kr": "kr", "thailand": "th", "th": "th",
    "indonesia": "id", "id": "id", "netherlands": "nl", "nl": "nl", "brazil": "br", "br": "br", "new zealand": "nz", "nz": "nz",
}

#: Pairs of words whose gap a worker remembers; frequent words meet often.
REMEMBERED_WORDS = 100_000

_BLANKS = ("", "nr", "n/a", "na")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def place(location: str | None) -> tuple[str | None, str | None]:
    """Town and country of a location written ``town, country``, ``town (country)``, as one of them, or not at all."""
    text = plain(location or "").strip()
    if text in _BLANKS:
        return None, None
    parts = [" ".join(p.split()) for p in re.split(r"[,()/;]", text)]
    parts = [p.strip(" .") for p in parts if p.strip(" .")]
    country = next((COUNTRIES[p] for p in reversed(parts) if p in COUNTRIES), None)
    towns = [p for p in parts if p not in COUNTRIES]
    return (towns[0] if towns else None), country


def spelling(name: str | None) -> tuple[tuple[str, ...], str | None]:
    """The telling words of a name in their order, and its initials where it is written by them alone.

    Legal forms, generic words, possessives, accents and punctuation are dropped, abbreviations and nicknames written
    out, words run together parted at their capitals. A name of generic words only keeps them.
    """
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2})", " ", name or "") if re.search(r"[A-Z][a-z]+[A-Z][a-z]{2}", name or "") else name or ""
    text = re.sub(r"['’`´]s\b", "", plain(text).replace("&", " and "))
    text = re.sub(r"['’`´]", "", text)
    text = re.sub(r"\b((?:[a-z]\.\s*){2,})", lambda m: " " + re.sub(r"[.\s]", "", m[1]) + "§ ", text)
    words = re.sub(r"[^a-z0-9§]+", " ", text).split()
    dotted = [w[:-1] for w in words if w.endswith("§")]
    words = [w.rstrip("§") for w in words]
    run, joined = [], []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 1:
            joined.append("".join(run))
            dotted.append("".join(run))
        else:
            joined += run
        run = []
        if w:
            joined.append(w)
    core = [WRITTEN_OUT.get(w, w) for w in joined if w not in GENERIC and w not in LEGAL]
    core = core or joined
    if len(core) == 1 and 2 <= len(core[0]) <= 5:
        w = core[0]
        shouted = any(t.strip(",") == w.upper() for t in (name or "").split()) and not (name or "").isupper()
        if w in dotted or shouted or not re.search("[aeiouy]", w):
            return (), w
    return tuple(core), None


def distance(a: str, b: str, most: int) -> int:
    """Letters changed, left out, put in or swapped with the next, cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = row[j - 1] if x == y else 1 + min(row[j - 1], row[j], new[j - 1])
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


@lru_cache(maxsize=REMEMBERED_WORDS)
def word_gap(a: str, b: str) -> float:
    """0 for equal words, up to 2 for typos, 0.5 for an abbreviation or an initial, 9 for different words."""
    if a == b:
        return 0
    short, long = sorted((a, b), key=len)
    if short[0] == long[0]:
        if len(short) == 1:
            return 0.5
        if len(short) < len(long) and len(short) <= 4 and not re.search("[aeiou]", short[1:]) and short == re.sub("[aeiou]", "", long[0] + long[1:])[: len(short)]:
            return 0.5
        if len(short) >= 3 and short[0] + re.sub("[aeiou]", "", short[1:]) == short and short == long[0] + re.sub("[aeiou]", "", long[1:]):
            return 0.5
    most = 0 if len(short) < 4 else 1 if len(short) < 7 else 2
    d = distance(a, b, most)
    return d if d <= most else 9


def gaps(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, float]:
    """How far two spellings' telling words are apart in any order, 9 and more if they are different names; and how far
    those two words are that are furthest apart, 0 for names of other numbers of words."""
    if a == b:
        return 0, 0
    if sorted(a) == sorted(b):
        return 0.1, 0
    if len(a) != len(b):
        joined = distance("".join(a), "".join(b), 1)
        return (0.3 + joined if joined <= 1 else 9), 0
    total, most, rest = 0.0, 0.0, list(b)
    for w in a:
        near = [word_gap(w, x) for x in rest]
        least = min(near)
        del rest[near.index(least)]
        total, most = total + least, max(most, least)
        if total >= 9:
            break
    return total, most


def gap(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    return gaps(a, b)[0]


def widest(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    return gaps(a, b)[1]

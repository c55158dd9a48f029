"""Typed names of businesses and persons, taken apart: given name, proper names, trade; legal forms, titles and phone numbers left out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from weftline.functions.similarity import edits
from weftline.llm.lookalike import folded

# Legal forms.
LEGAL = "llc llp ltd limited inc lnc incorporated corp corporation co company pvt private sarl sas sasu eurl plc gmbh sa snc".split()
# Titles and forms of address.
TITLES = "dr mr mrs ms miss smt shri sri prof mme mlle messrs".split()
# Words that name no one.
FILLERS = "the of and et de des du la le services service partners center centre group holding associes conseil compagnie fils freres null none na".split()
# Words and short forms of trades, by trade.
TRADES = {
    "furniture": "furniture furnitures furn", "hardware": "hardware hrdwr hdwe hdw", "pharmacy": "pharmacy pharm phcy pharmacie phie", "catering": "catering caterers cater ctrg",
    "logistics": "logistics logistic logist", "plumbing": "plumbing plumb plbg plombing", "law": "law office offices ofc off", "dental": "dental clinic dent dntl clin",
    "auto": "auto repair automotive rpr repairs", "manufacturing": "manufacturing mfg manuf", "insurance": "insurance ins insur", "bakery": "bakery bakers bkry bakeries",
    "landscaping": "landscaping landscpg landscapers lndscpg", "printing": "printing prtg print printers prntg", "roofing": "roofing roofers roof rfg", "accounting": "accounting acctg acct accountants",
    "motors": "motors motor mtrs", "sweets": "sweets sweet swts", "electric": "electricals electrical elect elec electricite electriciens", "textiles": "textiles textile tex", "stores": "stores store strs",
    "industries": "industries industry ind inds", "jewellers": "jewellers jewelers jwlrs jewellery", "engineering": "engineering engg engineers", "enterprises": "enterprises enterprise ent entp entps",
    "medicals": "medicals medical med", "coiffure": "coiffure coiff coiffeur coiffeurs", "fleuriste": "fleuriste fleur fleuristes", "peinture": "peinture peint peintures peintres", "garage": "garage gar garages",
    "traiteur": "traiteur trait traiteurs", "couverture": "couverture couv couvreurs couvertures", "boucherie": "boucherie bouch boucheries bouchers", "imprimerie": "imprimerie impr imprimeurs",
    "librairie": "librairie libr librairies", "assurances": "assurances assur assurance", "boulangerie": "boulangerie boul boulang boulangers", "plomberie": "plomberie plomb plombiers", "menuiserie": "menuiserie menuis menuisiers",
    "maconnerie": "maconnerie macon macons", "coffee": "coffee", "optics": "optics", "fuels": "fuels", "foods": "foods",
}
# Short and other forms of given names, by given name; a sample of what is common, others may be given to NameReader.
GIVEN = {
    "william": "will bill billy wm", "katherine": "kate kathy cathy catherine kathryn cath", "michael": "mike mick", "patricia": "pat trish patty", "james": "jim jas jimmy",
    "elizabeth": "liz beth eliza elisabeth babeth elise betty", "edward": "ed eddie ned ted", "robert": "bob rob robt bobby", "richard": "rick dick rich", "charles": "chuck charlie chas",
    "margaret": "maggie peggy meg", "theodore": "theo ted teddy", "samuel": "sam sammy", "daniel": "dan danny", "thomas": "tom tommy", "jennifer": "jen jenn jenny", "joseph": "joe joey",
    "john": "jack johnny", "david": "dave", "anthony": "tony", "benjamin": "ben benny", "nicholas": "nick nicky", "matthew": "matt", "andrew": "andy", "christopher": "chris", "stephen": "steve steven",
    "gregory": "greg", "jeffrey": "jeff", "timothy": "tim", "kenneth": "ken kenny", "ronald": "ron ronnie", "donald": "don donnie", "lawrence": "larry", "susan": "sue susie", "deborah": "deb debbie",
    "barbara": "barb", "rebecca": "becky", "victoria": "vicky", "jessica": "jess", "kimberly": "kim", "pamela": "pam", "cynthia": "cindy", "christina": "tina",
    "lakshmi": "laxmi lakshmy", "krishna": "krish kishan krishnan", "mohammed": "md mohd mohamed muhammad mohammad", "venkatesh": "venky venkat", "subramanian": "subbu mani subramaniam",
    "rajendra": "raju rajinder raj", "chandrasekhar": "chandru shekhar chandra", "padmavati": "padma", "frederic": "fred fredo", "alexandre": "alex", "dominique": "dom domi", "philippe": "phil",
    "christophe": "chris", "jeanpierre": "jp jean pierre",
}
_TRADE_OF = {w: t for t, ws in TRADES.items() for w in ws.split()}
_GIVEN_OF: dict[str, frozenset[str]] = {}
for _g, _ws in GIVEN.items():
    for _w in [_g, *_ws.split()]:
        _GIVEN_OF[_w] = _GIVEN_OF.get(_w, frozenset()) | {_g}
_DROPPED = {*LEGAL, *TITLES, *FILLERS}
# Digits read in place of letters.
_DIGITS = str.maketrans("0134567899", "oleasgtbgg")
_PHONE = re.compile(r"\+?\d[\d\s().\-]{6,}\d")
_DOTTED = re.compile(r"(?<![a-z0-9.])(?:[a-z0-9]\.)+[a-z0-9]\.?(?![a-z0-9])")
_DOTTED_WIDE = re.compile(r"(?<![a-z0-9.])(?:[a-z0-9]\. ?){2,}(?![a-z0-9])")
_PRIVATE = re.compile(r"\(p\)|\bp\.?\s+(?=l[t7]d|[l1]imited)")
_SPACED = re.compile(r"(?<![a-z0-9])((?:[a-z] ){2,3}[a-z])(?![a-z0-9])")
_ALIAS = re.compile(r"^(.+?)\s(?:d/b/a|dba|a/k/a|aka|f/k/a|fka|t/a|formerly(?: known as)?|trading as|doing business as|also known as|nee)[:\s]+(.+)$")
_WEB = re.compile(r"(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.{1,2}(?:[e3]xamp[l1][e3]|com|net|org|in|fr|co|biz|info)(?:\.[a-z]{2})?\b/?")
# Devanagari letters and signs in Latin letters.
_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p f b bh m y r l v sh sh s h".split()))
_VOWELS = dict(zip("अआइईउऊऋएऐऑओऔ", "a a i i u u ri e ai o o au".split()))
_SIGNS = dict(zip("ािीुूृेैॉोौ", "a i i u u ri e ai o o au".split()))


def from_devanagari(text: str) -> str:
    """Latin letters for Devanagari ones; the vowel inside a consonant is written unless a sign, a stop or a word's end follows."""
    out = []
    for i, ch in enumerate(text):
        nxt = text[i + 1 : i + 2]
        if nxt == "\u093c":
            nxt = text[i + 2 : i + 3]
        if ch in _CONSONANTS:
            out.append("z" if ch == "ज" and text[i + 1 : i + 2] == "\u093c" else _CONSONANTS[ch])
            if nxt and "\u0900" <= nxt <= "\u097f" and nxt not in _SIGNS and nxt != "\u094d":
                out.append("a")
        elif ch in _VOWELS or ch in _SIGNS:
            out.append(_VOWELS.get(ch) or _SIGNS[ch])
        elif ch in "\u0902\u0901":
            out.append("n")
        elif not "\u0900" <= ch <= "\u097f":
            out.append(ch)
    return "".join(out).replace("ks", "x")


_WORD = re.compile(r"[^\W_]+")


def _joined(m: re.Match) -> str:
    letters = re.sub(r"[\s.]", "", m[0])
    return f" {letters} " if letters.translate(_DIGITS) in _DROPPED or letters == "jp" else m[0]


@dataclass(frozen=True)
class Name:
    """``given``: possible given names; ``initial``: of a given name written short; ``proper``: proper names in order of the alphabet; ``proper_initial``: of one written short; ``trade``; ``web``: the label of a web address."""

    given: tuple[str, ...] = ()
    initial: str = ""
    proper: tuple[str, ...] = ()
    proper_initial: str = ""
    trade: str = ""
    web: str = ""

    def key(self) -> str:
        return "|".join([",".join(self.given), self.initial, ",".join(self.proper), self.proper_initial, self.trade, self.web])

    @staticmethod
    def of(key: str) -> Name:
        g, i, p, pi, t, w = key.split("|")
        return Name(tuple(filter(None, g.split(","))), i, tuple(filter(None, p.split(","))), pi, t, w)


def shorter(word: str) -> set[str]:
    """The word and what is left of it without one letter: strings one edit apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class NearWords:
    """Finds the entry of a table one edit away from a word, both of at least ``least`` letters."""

    def __init__(self, words: list[str], least: int = 5):
        self.least, self.at = least, {}
        for w in words:
            if len(w) >= least:
                for v in shorter(w):
                    self.at.setdefault(v, set()).add(w)

    def find(self, word: str) -> str | None:
        if len(word) < self.least:
            return None
        near = {w for v in shorter(word) for w in self.at.get(v, ()) if edits(word, w, 1) <= 1}
        return min(near, default=None)


_NEAR_GIVEN, _NEAR_TRADE, _NEAR_LEGAL = NearWords(list(_GIVEN_OF)), NearWords(list(_TRADE_OF)), NearWords(LEGAL)


class NameReader:
    """``trades`` and ``nicknames`` add to the fixed tables: trade of a word, given names of a word."""

    def __init__(self, bound: int = 300_000, trades: dict[str, str] | None = None, nicknames: dict[str, list[str]] | None = None):
        self.known: dict[str, tuple[str, object]] = {}
        self.bound = bound
        self.trade_of = {**(trades or {}), **_TRADE_OF}
        self.given_of = {**_GIVEN_OF, **{w: _GIVEN_OF.get(w, frozenset()) | frozenset(g) for w, g in (nicknames or {}).items()}}
        self.near_trade = NearWords(list(self.trade_of)) if trades else _NEAR_TRADE
        self.near_given = NearWords(list(self.given_of)) if nicknames else _NEAR_GIVEN

    def _kind(self, word: str) -> tuple[str, object]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > self.bound:
                self.known.clear()
            got = self.known[word] = self._look_up(word)
        return got

    def _look_up(self, word: str) -> tuple[str, object]:
        if word.isdigit():
            return "none", ""
        forms = [word]
        if any(c.isdigit() for c in word):
            mended = word.translate(_DIGITS)
            forms = [mended, word.replace("1", "i").translate(_DIGITS)]
        for w in forms:
            if w in _DROPPED:
                return "none", ""
            if w in self.trade_of:
                return "trade", self.trade_of[w]
            if w in self.given_of:
                return "given", self.given_of[w]
        w = forms[0]
        if len(w) == 1:
            return "initial", w
        if (n := self.near_given.find(w)) is not None:
            return "given", self.given_of[n]
        if (n := self.near_trade.find(w)) is not None:
            return "trade", self.trade_of[n]
        if _NEAR_LEGAL.find(w) is not None:
            return "none", ""
        return "proper", w

    def read(self, raw: str | None, country: str | None = None) -> Name | None:
        """None where nothing is left that could name anyone."""
        return None if raw is None else self.name(*self.words(raw), country)

    @staticmethod
    def words(raw: str) -> tuple[list[str], str]:
        """The words of a typed name and the label of its web address."""
        text = folded(from_devanagari(raw) if any("\u0900" <= c <= "\u097f" for c in raw) else raw)
        text = _PHONE.sub(" ", text)
        text = re.sub(r"\bm\s*/\s*s\b", " ", text)
        if (m := _ALIAS.match(text)) is not None:
            text = m[2]
        web = ""
        for part in text.split("|"):
            if (m := _WEB.search(part)) is not None:
                label = m[1].replace("-", "")
                web = web or (label if label.isdigit() else label.translate(_DIGITS))
        bare = _WEB.sub(" ", text)
        text = _DOTTED_WIDE.sub(_joined, _DOTTED.sub(_joined, _PRIVATE.sub(" ", bare)))
        text = _SPACED.sub(lambda m: m[1].replace(" ", "") if m[1].replace(" ", "") in _DROPPED else m[0], text)
        return _WORD.findall(text.replace("'", "")), web

    def name(self, words: list[str], web: str = "", country: str | None = None) -> Name | None:
        given: frozenset[str] | None = None
        initials, proper, trade = [], [], ""
        for word in words:
            kind, value = self._kind(word)
            if kind == "given":
                given = value if given is None else (given & value or given)
            elif kind == "trade":
                trade = trade or value
            elif kind == "initial":
                initials.append(value)
            elif kind == "proper":
                proper.append(value)
        if (country or "").lower() == "france" or given:
            initials = [i for i in initials if i != "m"] or (initials if len(proper) < 2 and not given else [])
        initial = proper_initial = ""
        if initials:
            if len(proper) >= 2 and not given:
                initial = initials[0]
            elif len(proper) == 1:
                proper_initial = initials[-1]
                if len(initials) > 1 and not given:
                    initial = initials[0]
        if not proper and not web:
            return None
        return Name(tuple(sorted(given or ())), initial, tuple(sorted(set(proper))), proper_initial, trade, web)


# Consonants that are easily taken for each other, by the letter that stands for them.
_SOUNDS = str.maketrans("bpfvckgjqxszdtlmnr", "bbvvkkkkksssttlmmr")


def sound(word: str) -> str:
    """A phonetic code: the first letter's class, then the classes of the consonants, neighbours alike once."""
    coded = word.replace("ph", "f").replace("th", "t").replace("sh", "s").translate(_SOUNDS)
    out = coded[:1] if coded[:1] not in "aeiouyhw" else "a"
    for ch in coded[1:]:
        if ch not in "aeiouyhw" and ch != out[-1:]:
            out += ch
    return out

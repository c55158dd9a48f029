"""Postal addresses taken apart: house number, direction, street, kind of street, town, postcode, state; units and landmarks left out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from weftline.llm.lookalike import folded
from weftline.llm.names import NearWords

# States, by code.
US_STATES = "al alabama,ak alaska,az arizona,ar arkansas,ca california,co colorado,ct connecticut,de delaware,fl florida,ga georgia,hi hawaii,id idaho,il illinois,in indiana,ia iowa,ks kansas,ky kentucky,la louisiana,me maine,md maryland,ma massachusetts,mi michigan,mn minnesota,ms mississippi,mo missouri,mt montana,ne nebraska,nv nevada,nh new hampshire,nj new jersey,nm new mexico,ny new york,nc north carolina,nd north dakota,oh ohio,ok oklahoma,or oregon,pa pennsylvania,ri rhode island,sc south carolina,sd south dakota,tn tennessee,tx texas,ut utah,vt vermont,va virginia,wa washington,wv west virginia,wi wisconsin,wy wyoming"
IN_STATES = "ap andhra pradesh,ar arunachal pradesh,as assam,br bihar,cg chhattisgarh,dl delhi,ga goa,gj gujarat,hr haryana,hp himachal pradesh,jh jharkhand,ka karnataka,kl kerala,mp madhya pradesh,mh maharashtra,mn manipur,ml meghalaya,mz mizoram,nl nagaland,od odisha,or orissa,pb punjab,rj rajasthan,sk sikkim,tn tamil nadu,tg telangana,ts telangana,tr tripura,up uttar pradesh,uk uttarakhand,wb west bengal"
FR_REGIONS = "naq nouvelle aquitaine,naq gironde,pdl pays de la loire,pdl loire atlantique,hdf hauts de france,hdf nord,idf ile de france,ara auvergne rhone alpes,occ occitanie,paca provence alpes cote d azur,ges grand est,bre bretagne,nor normandie,bfc bourgogne franche comte,cvl centre val de loire,cor corse"
# Kinds of streets with their short forms.
US_KINDS = "street st str,avenue ave av avn,road rd,lane ln,drive dr drv,court ct crt,boulevard blvd boul,parkway pkwy pky,terrace ter terr,place pl,way,circle cir,highway hwy,square sq"
IN_KINDS = "road rd,marg mg,nagar ngr nagr,chowk chk,lane ln gali,cross crs x,street st,colony col,bazaar bazar,path"
FR_KINDS = "rue r,avenue av ave,boulevard bd bvd boul blvd,place pl,chemin ch che chem,impasse imp,allee all,quai qu,route rte,cours crs,square sq"
_ARTICLES = {"de", "du", "des", "la", "le", "les", "l", "d", "en", "sur"}
_DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "n": "n", "s": "s", "e": "e", "w": "w"}
_UNIT = re.compile(r"\b\d+ ?(?:st|nd|rd|th) (?:floor|flr|fl)\b|\b(?:apt|apartment|unit|suite|ste|flat|office|shop|room|appt|appartement|etage|bat|batiment|floor|flr)\b[. ]*#? ?(?:\d{1,4}[a-z]?|[a-z])\b")
_LANDMARK = re.compile(r"\b(?:near|nr|opp|opposite|behind|beside)\b\.? +[^\W_]+ +[^\W_]+")
_MARK = re.compile(r"\bn ?° ?|#|\b(?:(?:plot|door|house|h|shop)[. ]*)?no\b[. ]*(?=\d)")
_EMPTY = re.compile(r"\b(?:null|none|n/a|nan)\b")
_COUNTRY = re.compile(r"(?<!-)(?<!de )\b(?:united states(?: of america)?|u\.?s\.?a\.?|india|bharat|france)(?=\W|$)(?!-)")
_PARTS = re.compile(r"[,;/|]| - ")
_TOKEN = re.compile(r"[^\W_]+")
_POSTCODE = re.compile(r"[1-9]\d{4,5}")


def _kinds(table: str) -> dict[str, str]:
    return {w: ws.split()[0] for ws in table.split(",") for w in ws.split()}


def _states(table: str) -> tuple[dict[str, str], list[tuple[re.Pattern, str]]]:
    pairs = [x.split(" ", 1) for x in table.split(",")]
    named = sorted(((n, c) for c, n in pairs), key=lambda x: -len(x[0]))
    return {c: c for c, _ in pairs}, [(re.compile(r"\b" + n.replace(" ", "[ -]+") + r"\b"), c) for n, c in named]


_TABLES = {"us": (_kinds(US_KINDS), *_states(US_STATES)), "in": (_kinds(IN_KINDS), *_states(IN_STATES)), "fr": (_kinds(FR_KINDS), {}, _states(FR_REGIONS)[1])}
_NEAR = {k: NearWords(list(t[0]), least=4) for k, t in _TABLES.items()}
_SAME_STATE = {"ts": "tg", "or": "or"}


@dataclass(frozen=True)
class Place:
    land: str = ""
    number: str = ""
    way: str = ""
    street: str = ""
    kind: str = ""
    town: str = ""
    postcode: str = ""
    state: str = ""

    def key(self) -> str:
        return "|".join((self.land, self.number, self.way, self.street, self.kind, self.town, self.postcode, self.state))

    @staticmethod
    def of(key: str) -> Place:
        return Place(*key.split("|"))


def _land(text: str, country: str | None) -> str:
    if re.search(r"\b(?:rue|impasse|allee|quai|chemin|etage|appt|nouvelle aquitaine|pays de la loire)\b|\b(?:place|avenue|boulevard|bd|av|pl) (?:de|du|des|d|l)\b", text.replace("-", " ")):
        return "fr"
    if re.search(r"\b(?:chowk|nagar|marg|khurd)\b|\b[1-9]\d{5}\b", text):
        return "in"
    c = (country or "").strip().lower()
    if c in ("us", "usa", "united states"):
        return "us"
    if c in ("india", "in"):
        return "in"
    if c in ("france", "fr"):
        return "fr"
    if re.search(r"\b(?:hauts de france|france)\b", text.replace("-", " ")):
        return "fr"
    if re.search(r"\b(?:india|bharat|temple)\b", text) or any(p.search(text) for p, _ in _TABLES["in"][2]):
        return "in"
    return "us"


def read_place(raw: str | None, country: str | None = None) -> Place | None:
    """None for null, blank and filler texts."""
    if raw is None:
        return None
    text = _EMPTY.sub(" ", folded(raw))
    if not _TOKEN.search(text):
        return None
    land = _land(text, country)
    kinds, codes, named = _TABLES[land]
    text = _LANDMARK.sub(" ", _UNIT.sub(" ", _COUNTRY.sub(" ", _MARK.sub(" ", text))))
    state = ""
    parts = []
    for part in _PARTS.split(text):
        whole = " ".join(_TOKEN.findall(part))
        if not whole:
            continue
        for pattern, code in named:
            m = pattern.search(whole)
            # A state's name inside a street's part is the street's, unless a postcode or the end follows.
            if m and re.fullmatch(r"(?: \d+)?", whole[m.end() :]) and (m.end() < len(whole) or land == "fr" or not re.match(r"\d{1,4} (?:\w+ ){0,2}$", whole[: m.start()])):
                state, whole = state or code, whole[: m.start()] + " " + whole[m.end() :]
                break
            if m and m.start() == 0 and re.match(r" \d{5,6}\b", whole[m.end() :]):
                state, whole = state or code, whole[m.end() :]
                break
        parts.append(whole.split())
    parts = [p for p in parts if p]
    single = len(parts) == 1
    postcode = ""
    rest: list[list[str]] = []
    for i, p in enumerate(parts):
        out: list[str] = []
        for j, t in enumerate(p):
            nxt = p[j + 1] if j + 1 < len(p) else ""
            if not postcode and _POSTCODE.fullmatch(t):
                postcode = t
                out.append("^")
            elif t in codes and (_POSTCODE.fullmatch(nxt) or len(p) == 1 or (not nxt and i == len(parts) - 1 and (t not in kinds or not single)) ) and not (t in kinds and j > 0 and p[0].isdigit() and len(p[0]) < 5):
                state = state or t
            else:
                out.append(t)
        rest.append(out)
    number, at = "", None
    for i, p in enumerate(rest):
        for j, t in enumerate(p):
            if t.isdigit() and int(t) < 10_000:
                number, at = str(int(t)), (i, j)
                break
        if at:
            break
    before: list[str] = []
    if at:
        i, j = at
        before, after = rest[i][:j], rest[i][j + 1 :]
        if not [t for t in after if t != "^"] and i + 1 < len(rest):
            street_part, others = rest[i + 1], rest[:i] + rest[i + 2 :]
        else:
            street_part, others = after, rest[:i] + rest[i + 1 :]
    else:
        k = next((k for k, p in enumerate(rest) if any(t in kinds for t in p)), 0)
        street_part, others = (rest[k], rest[:k] + rest[k + 1 :]) if rest else ([], [])
    way = ""
    if land == "us" and len(street_part) > 2 and street_part[0] in _DIRECTIONS:
        way, street_part = _DIRECTIONS[street_part[0]], street_part[1:]
    street, kind, extra = _street(street_part, kinds, land, single)
    if not kind:
        for n, t in enumerate(street_part):
            near = _NEAR[land].find(t) if (n > 0 or land == "fr") else None
            if near:
                street, kind, extra = _street([near if m == n else x for m, x in enumerate(street_part)], kinds, land, single)
                break
    town = [t for t in [*before, *extra, *(t for p in others for t in p)] if t != "^" and not t.isdigit()]
    clean = lambda ts: "".join(t for t in ts if t not in _ARTICLES and t != "^") if land == "fr" else "".join(t for t in ts if t != "^")
    return Place(land, number, way, clean(street), kind, "".join(town), postcode, _SAME_STATE.get(state, state))


def _street(tokens: list[str], kinds: dict[str, str], land: str, single: bool) -> tuple[list[str], str, list[str]]:
    """Street, kind and what is left for the town."""
    if land == "fr":
        if tokens and tokens[0] in kinds:
            end = tokens.index("^") if "^" in tokens else len(tokens)
            return tokens[1:end], kinds[tokens[0]], tokens[end:]
        return tokens, "", []
    found = [n for n, t in enumerate(tokens) if t in kinds and n > 0]
    if not found:
        return tokens, "", []
    n = found[0] if single or len(found) == 1 else found[-1] if found[-1] < 3 else found[0]
    return tokens[:n], kinds[tokens[n]], tokens[n + 1 :]

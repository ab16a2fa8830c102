"""Lexicons and rules of the classifier and scorer: parameters, with fixed default values."""

from __future__ import annotations

from dataclasses import dataclass, field

SECURITY, DEVELOPMENT, SOCIETY, SPORTS = "Security & Strategic Affairs", "Development", "Society & Youth", "Sports & Achievements"
REGIONAL, NOT_RELEVANT = "Regional News", "Not Relevant"
#: Order of ties between themes.
THEMES = (SECURITY, DEVELOPMENT, SOCIETY, SPORTS)
#: Order of sections and of category tables.
CATEGORY_ORDER = (SECURITY, DEVELOPMENT, REGIONAL, SOCIETY, SPORTS)


# The default lexicons.
STATES = {"assam": 8, "arunachal pradesh": 8, "manipur": 8, "meghalaya": 8, "mizoram": 8, "nagaland": 8, "tripura": 8, "sikkim": 8}
ENTITIES = {
    "guwahati": 6, "dibrugarh": 5, "silchar": 5, "nagaon": 6, "lumding": 6, "tezpur": 5, "jorhat": 5, "tinsukia": 5, "dimapur": 6, "kohima": 6, "aizawl": 6, "champhai": 6,
    "imphal": 6, "shillong": 6, "tura": 5, "gangtok": 6, "itanagar": 6, "agartala": 6, "mokokchung": 5, "mon district": 5, "kuki": 5, "mizo": 5, "naga": 5, "bodo": 5,
    "north eastern council": 7, "nec": 5, "assam rifles": 8,
}
REGION = {
    "northeast": 7, "north east": 7, "north-eastern": 7, "north eastern": 7, "seven sisters": 7, "eight northeastern states": 8, "eight north eastern states": 8,
    "india-myanmar border": 8, "india-bangladesh border": 8, "myanmar border": 7, "bangladesh border": 7, "northeastern region": 7,
}
SECURITY_TERMS = {
    "indian army": 10, "army": 5, "assam rifles": 10, "border security": 8, "border": 3, "military": 6, "security forces": 7, "armed forces": 7, "insurgency": 8,
    "counter-insurgency": 9, "counter insurgency": 9, "militant": 7, "militancy": 7, "terrorism": 7, "terrorist": 7, "ceasefire": 6, "drug trafficking": 7, "drug-smuggling": 7,
    "drug smuggling": 7, "narcotics": 6, "heroin": 4, "smuggling": 5, "international border": 7, "infiltration": 7, "air force": 5, "iaf": 5, "defence": 5, "defense": 5,
    "strategic": 5, "china border": 8, "india-china": 8, "lac": 6,
}
DEVELOPMENT_TERMS = {
    "infrastructure": 6, "development": 5, "investment": 4, "funding": 5, "funds": 4, "government scheme": 5, "scheme": 3, "capital investment": 7, "roads": 4, "railway": 5,
    "railways": 5, "airport": 4, "connectivity": 6, "industry": 5, "industrial": 5, "land bank": 6, "land banks": 6, "modernisation": 5, "modernization": 5, "agriculture": 5,
    "farmers": 5, "coffee": 4, "education": 4, "healthcare": 4, "health": 3, "employment": 4, "jobs": 4, "economic": 4, "economy": 4,
}
SOCIETY_TERMS = {
    "youth": 7, "students": 5, "student": 5, "society": 4, "community": 5, "women": 5, "woman": 5, "children": 4, "school": 4, "college": 4, "university": 4, "civic": 5,
    "sanitation": 5, "garbage": 4, "citizens": 4, "civil society": 6, "journalist": 4, "journalists": 4,
}
SPORTS_TERMS = {
    "sports": 5, "sport": 4, "cricket": 6, "football": 6, "hockey": 6, "badminton": 6, "boxing": 6, "wrestling": 6, "athletics": 6, "marathon": 6, "golf": 5, "athlete": 5,
    "athletes": 5, "medal": 5, "gold medal": 7, "silver medal": 7, "bronze medal": 7, "asian games": 7, "olympics": 7,
}
IRRELEVANT = {
    "sunscreen": 8, "vps hosting": 8, "trading platform": 7, "option chain": 7, "emi calculator": 7, "home loan calculator": 7, "parenthood": 6, "fertility": 6,
}
BOOSTS = {
    SPORTS: (
        "marathon", "cricket", "football", "hockey", "badminton", "boxing", "wrestling", "athletics", "golf", "sports", "sport", "athlete", "athletes", "medal", "gold", "silver",
        "bronze", "asian games", "olympics",
    ),
    SECURITY: (
        "army", "assam rifles", "military", "border", "security", "insurgency", "militant", "militancy", "terrorism", "terrorist", "counter-insurgency", "counter insurgency",
        "defence", "defense", "iaf", "air force", "india-myanmar", "india-bangladesh", "china border",
    ),
    DEVELOPMENT: (
        "development", "industry", "industrial", "infrastructure", "railway", "railways", "airport", "connectivity", "investment", "funding", "funds", "scheme", "farmers",
        "agriculture", "modernisation", "modernization", "economy", "economic", "jobs", "employment",
    ),
    SOCIETY: (
        "youth", "students", "student", "school", "college", "university", "women", "woman", "children", "community", "civic", "citizens", "journalist", "journalists", "society",
    ),
}
GENERIC_TERMS = (
    "sunscreen", "dry skin", "skin care", "skincare", "emi calculator", "home loan emi", "find a home", "buy a home", "rent a home", "real estate guide", "vps hosting",
    "futures trading", "option chain", "trading platform", "cme aurora", "colocation", "parenthood", "fertility", "loan calculator",
)
GENERIC_STARTS = ("5 best", "best", "guide to", "complete guide", "how long does it", "how to", "calculator", "transform your")
TITLE_TERMS = {
    SPORTS: (
        "cricket", "odi", "t20", "test match", "football", "soccer", "hockey", "badminton", "boxing", "wrestling", "athletics", "athlete", "athletes", "marathon", "tournament",
        "championship", "champion", "medal", "gold medal", "silver medal", "bronze medal", "asian games", "olympic", "olympics", "golf", "shooting", "pitch", "runs", "wicket",
        "wickets", "bowling", "batting", "player", "players",
    ),
    SECURITY: (
        "assam rifles", "indian army", "army", "military", "border security", "security forces", "insurgency", "insurgent", "militant", "militancy", "terrorism", "terrorist",
        "counter insurgency", "counter-insurgency", "narcotics", "heroin", "drug trafficking", "drug smuggling", "arms", "weapons", "smuggling",
    ),
    DEVELOPMENT: (
        "development", "industry", "industrial", "infrastructure", "railway", "railways", "railway station", "airport", "connectivity", "investment", "funding", "funds",
        "land bank", "land banks", "project", "projects", "farmers", "agriculture", "coffee", "modernisation", "modernization", "employment", "jobs", "economy", "economic",
    ),
    SOCIETY: (
        "society", "social", "community", "communities", "youth", "student", "students", "school", "schools", "college", "university", "women", "woman", "children", "child",
        "health", "healthcare", "civic", "garbage", "waste", "sanitation", "pollution", "environment", "culture", "cultural", "tribal", "residents", "citizens",
    ),
    REGIONAL: (
        "bypoll", "by-election", "byelection", "election", "elections", "political", "politics", "chief minister", "assembly", "mla", "mp", "campaign", "government",
        "administration", "minister", "political party",
    ),
}
SCORER_SECURITY = (
    "army", "indian army", "assam rifles", "military", "defence", "defense", "border", "border security", "india-myanmar border", "myanmar border", "drug trafficking",
    "drug-smuggling", "narcotics", "heroin", "insurgency", "security forces", "armed forces", "air force", "iaf", "bsf", "paramilitary", "terrorism", "counter-insurgency",
)
SOURCE_SCORES = {"The Assam Tribune": 90}
DEFAULT_SOURCE_SCORE = 60
SCORE_WEIGHTS = {"region": 0.30, "theme": 0.25, "security": 0.15, "freshness": 0.10, "source": 0.10, "content": 0.10}
GROUPS = {
    "Assam": ("assam", "guwahati", "dibrugarh", "nagaon", "lumding"),
    "Arunachal Pradesh": ("arunachal", "itanagar"),
    "Manipur": ("manipur", "imphal", "kangpokpi"),
    "Meghalaya": ("meghalaya", "shillong"),
    "Mizoram": ("mizoram", "aizawl"),
    "Nagaland": ("nagaland", "kohima", "dimapur"),
    "Tripura": ("tripura", "agartala"),
    "Sikkim": ("sikkim", "gangtok"),
}
STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "these", "those", "into", "along", "about", "write", "article", "magazine", "northeast", "india", "news", "latest",
    "report", "reports", "issue", "issues", "question", "questions", "using", "only", "retrieved", "source", "sources", "evidence",
)
KEY_PHRASES = (
    "nagaon", "bangladesh", "bypoll", "women", "mizoram", "nagaland", "manipur", "assam", "guwahati", "lumding", "lalduhoma", "kangpokpi", "railway", "coffee", "heroin",
    "assam rifles", "india-myanmar", "myanmar border", "odi",
)
CLAIM_ENTITIES = (
    "assam", "arunachal pradesh", "manipur", "meghalaya", "mizoram", "nagaland", "sikkim", "tripura", "northeast india", "northeastern india", "northeast", "northeastern",
    "india-myanmar border", "myanmar border", "golden triangle", "indian army", "army", "assam rifles", "bsf", "iaf", "air force", "security forces", "paramilitary", "government",
    "centre", "central government", "state government", "heroin", "methamphetamine", "yaba", "ganja", "narcotics", "drug trafficking", "drug smuggling", "ndps act",
    "narcotic drugs and psychotropic substances act",
)


@dataclass(frozen=True)
class Lexicons:
    """Everything that the classifier and the scorer take as parameters."""

    states: dict[str, int] = field(default_factory=lambda: STATES)
    entities: dict[str, int] = field(default_factory=lambda: ENTITIES)
    region: dict[str, int] = field(default_factory=lambda: REGION)
    themes: dict[str, dict[str, int]] = field(default_factory=lambda: dict(zip(THEMES, (SECURITY_TERMS, DEVELOPMENT_TERMS, SOCIETY_TERMS, SPORTS_TERMS), strict=True)))
    irrelevant: dict[str, int] = field(default_factory=lambda: IRRELEVANT)
    boosts: dict[str, tuple[str, ...]] = field(default_factory=lambda: BOOSTS)
    generic_terms: tuple[str, ...] = GENERIC_TERMS
    generic_starts: tuple[str, ...] = GENERIC_STARTS
    titles: dict[str, tuple[str, ...]] = field(default_factory=lambda: TITLE_TERMS)
    security_hits: tuple[str, ...] = SCORER_SECURITY
    source_scores: dict[str, int] = field(default_factory=lambda: SOURCE_SCORES)
    groups: dict[str, tuple[str, ...]] = field(default_factory=lambda: GROUPS)


#: Words that do occur in the fixtures, so that every branch of the rules has rows.
FIXTURE = Lexicons(
    states={"the": 8, "que": 8, "der": 6},
    entities={"thnd": 5, "und": 5, "of the": 6, "elle": 5, "éch": 4},
    region={"and the": 7, "ción": 7, "nicht": 7},
    themes={
        SECURITY: {"with": 6, "that": 5, "is the": 10, "por": 6},
        DEVELOPMENT: {"from": 5, "of": 4, "des": 6, "für": 6},
        SOCIETY: {"this": 7, "are": 5, "un": 5, "ein": 5},
        SPORTS: {"by": 6, "on": 5, "con": 6, "sich": 7},
    },
    irrelevant={"pathetic": 8, "license": 7, "token": 6},
    boosts={SECURITY: ("with", "that"), DEVELOPMENT: ("from", "des"), SOCIETY: ("this", "un"), SPORTS: ("by", "con")},
    generic_terms=("license", "all rights"),
    generic_starts=("the and", "therhean", "de"),
    titles={SPORTS: ("by", "sich"), SECURITY: ("with", "por"), DEVELOPMENT: ("from", "des"), SOCIETY: ("this", "un"), REGIONAL: ("are", "las")},
    security_hits=("with", "thnd", "army", "por", "ouble"),
    source_scores={"src1": 90, "src3": 75},
    groups={"north": ("the", "que"), "south": ("der", "las"), "west": ("pathetic", "idiot")},
)

"""A vocabulary of words that occur in the supplied (invented) text, so that every rule can fire.

The shape of the rules is that of the default vocabulary; only the words differ.
"""

from __future__ import annotations

from turnloom.functions.regex import raw, terms
from turnloom.functions.vocab import CONTEXT_RULES, CURRENT_RULES, DEFAULT, SCORED_DOMAINS, STRUCTURE_RULES

# words found in the text, from common to less common
WORDS = (
    "thre ther thth thha thea than thon das thin ble thnd erth thhe thor thti erin thou then eau lich thing los sich "
    "thst ver thble ung erea erer ernt nci thed eran erst thnt erat ernd heit eron thsh dem erre ment mit onon onti del "
    "erti onan thes enst ered ering onre tre ach ado auf keit onnd elle eren por enen erha ist oned thly ber onou reea "
    "mente onen onor eux las onin une anon nicht onhe anan aux erble erly ersh ones annd anre erou erwh onat oner anen "
    "anti con rees rein anble eres erhe eror ier onwh reth retion anly anor antion eine ertion hewh onha"
).split()


def _rules(names, offset: int, step: int = 1) -> dict:
    return {name: terms(WORDS[(offset + i * step) % len(WORDS)]) for i, name in enumerate(names)}


_scores = {
    d: terms(*[WORDS[(3 + i * 5 + j * 11) % len(WORDS)] for j in range(3)]) for i, d in enumerate(SCORED_DOMAINS)
}
KEYWORDS = {
    "coding": ["onre", "erble"],
    "support": ["thnd", "heit"],
    "sales": ["price", "antion"],
    "legal": ["erwh"],
    "medical": ["nicht", "onou"],
    "commerce": ["pricer", "ann"],
    "education": ["erst"],
    "urgency": ["thshon", "reea", "leon", "erha", "edan"],
    "crisis": ["anenly", "thble hen", "erinar"],
    "unsafe": ["onblean", "thisth"],
}
AFFECT = {"distressed": ["thrent", "anonda"], "frustrated": ["esth", "eror"], "positive": ["oning", "lich"]}

TEST = DEFAULT.with_(
    keyword_groups=KEYWORDS,
    affect_words=AFFECT,
    structures={
        **_rules(STRUCTURE_RULES, 20),
        "code_block": raw(r"erre[\s\S]*erre", (r"erre[\s\S]*erre", ("erre",))),
    },
    context=_rules(CONTEXT_RULES, 60, 2),
    current=_rules(CURRENT_RULES, 25, 3),
    scores=_scores,
    small_talk=terms("thon", "thin", "eau"),
    distractors=("thre", "thea", "than", "das", "los"),
    extra_distractors=((r"\bof (?:the|that) ", 3), (r"\bund der\b", 3), (r"\bde la\b", 2)),
    on_topic=terms("erer", "ernt", "ung"),
    domain_patterns={
        "coding": r"\b(thti|thor|thhe|thing)\b|\bth[a-z]{5}\b",
        "customer_support": r"\b(order|eran|erst)\b|e{2,}",
        "sales": r"\b(thnt|erat)\b|[A-Z]on",
        "legal": r"\b(nicht|der|die)\b",
        "medical": r"\b(que|les|des)\b",
        "commerce": r"\b(los|del|por)\b",
        "education": r"\b(for|was|with)\b",
        "general": r"\b(from|this|are)\b",
    },
    structure_boosts={
        "coding": (r"(?i)th[a-z]+th\b", 4),
        "customer_support": (r"(?i)er[a-z]{1,4}er\b", 4),
        "sales": (r"(?i)\bon[a-z]+on\b", 4),
        "medical": (r"\b[a-z]{2}eau[a-z]*\b", 3),
    },
    action_boosts={
        "coding": (terms("erin", "thou"), 3),
        "customer_support": (terms("thnd", "erth"), 3),
        "sales": (terms("then", "thst"), 3),
        "medical": (terms("eux", "elle"), 3),
        "legal": (terms("ver", "lich"), 3),
        "education": (terms("ble", "erea"), 2),
        "commerce": (terms("nci", "ado"), 2),
        "general": (terms("ered", "onan"), 2),
    },
    fact_patterns={
        "coding": (r"(?i)\bthor|thing|bleth\b", r"\b[a-z]{2}eron[a-z]*\b", "CODE_BLOCK"),
        "customer_support": (r"(?i)\border|eran\b",),
        "sales": (r"(?i)\bantion|onan\b",),
        "legal": (r"(?i)\bnicht|keit\b",),
        "medical": (r"(?i)\beaux|elle\b",),
        "commerce": (r"(?i)\bci[a-z]+\b",),
        "education": (r"\b[A-Z][a-z]{8,}\b",),
        "general": (r"(?i)\bthat [a-z]+\b", r"\b[a-z]{9,}\b"),
    },
)
PLUGINS = (
    {"id": "alpha", "label": "Alpha", "keywords": ["thwhst", "eblen"], "behavior": "Alpha behavior.", "constraints": "Alpha rule."},
    {"id": "beta", "label": "Beta", "keywords": ["erble", "lichsch"], "behavior": "", "constraints": "Beta rule."},
    {"id": "gamma", "label": "Gamma", "keywords": ["Onan", "quel"], "behavior": "Gamma behavior.", "constraints": ""},
)

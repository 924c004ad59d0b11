"""Word lists and label sets that operators use by default, ordered by last letter and length."""

from __future__ import annotations

STOPWORDS_UPPER = frozenset(
    """
AND DID HAD SHOULD BE HE ME WE ARE SHE THE HAVE HERE MORE ONCE SAME SOME WERE ABOVE THERE THESE THOSE WHERE
WHILE BEFORE BECAUSE IF OF OFF ITSELF MYSELF HERSELF HIMSELF YOURSELF AMONG BEING DOING DURING HAVING BOTH
EACH SUCH WITH WHICH THROUGH ALL UNTIL AM HIM FROM THEM WHOM AN IN ON CAN OWN BEEN DOWN THAN THEN WHEN AGAIN
BETWEEN DO NO SO TO TOO WHO INTO UP OR FOR HER NOR OUR OVER YOUR AFTER OTHER THEIR UNDER FURTHER AS IS HAS HIS
ITS WAS DOES HERS OURS THIS YOURS THEIRS OURSELVES THEMSELVES YOURSELVES AT IT BUT NOT OUT JUST MOST THAT WHAT
ABOUT YOU FEW HOW NOW BELOW BY MY ANY WHY ONLY THEY VERY
""".split()
)
#: Both cases, as token filters compare them.
STOPWORDS = STOPWORDS_UPPER | {w.lower() for w in STOPWORDS_UPPER}

#: Synonyms of risk; case as given.
RISK_WORDS = frozenset(
    """
dilemma erratic hazard risked exposed undecided unsettled likelihood unresolved undetermined vague chance
gamble menace niggle unsafe unsure scruple venture insecure unstable variable debatable tentative changeable
diffidence indecisive irresolute jeopardize unreliable ambivalence disquietude incertitude speculative
incalculable undependable unforeseeable unpredictable halting pending risking varying wavering faltering
misgiving hesitating fluctuating oscillating vacillating equivocating risk peril fitful imperil doubtful
changeful qualm skepticism torn unknown question suspicion uncertain indecision reservation vacillation
apprehension equivocation irresolution fear wager danger riskier unclear endanger irregular risks dubious
parlous queries perilous wariness chariness dangerous hazardous questions riskiness vagueness chanciness
fickleness fitfulness precarious unsureness defenseless treacherous doubtfulness perilousness tentativeness
uncertainties changeableness precariousness bet doubt threat disquiet hesitant prospect riskiest diffident
fluctuant ambivalent unconfident hazy iffy dicey dodgy hairy query risky chancy gnarly sticky tricky dubiety
jeopardy quandary hesitancy insecurity inconstancy instability possibility probability uncertainty variability
changeability unreliability untrustworthy unpredictability
""".split()
)

_ADVERBS = ("RB", "RBR", "RBS")
#: Pairs of part-of-speech tags that a dictionary of word pairs leaves out.
STOP_TAG_PAIRS = frozenset(
    [(a, b) for a in ("PRP", "PRP$") for b in ("PRP", "PRP$")]
    + [(a, b) for a in _ADVERBS for b in ("IN", "WRB", "DT")]
    + [(a, b) for a in ("IN", "WRB", "DT") for b in _ADVERBS]
    + [(a, a) for a in ("IN", *_ADVERBS)]
    + [("RB", "RBR"), ("RB", "RBS"), ("RBR", "RBS")]
    + [(a, b) for a in ("IN", "WRB", "DT") for b in ("IN", "WRB", "DT") if a != b]
)
#: Single words that such a dictionary leaves out, in lower case.
STOP_PAIR_WORDS = frozenset("id im wed were weve ive i thats that youd youre youve".split())

PUNCTUATION_TAGS = frozenset("SQT NFP LRB ! HYPH ? EQT ; RRB : , . 'S `` '' ` ' \" ( ) [ ] { }".split()) | {f"-{side}{kind}B-" for side in "LR" for kind in "RSC"}
ENTITY_TAGS = frozenset("DATE TIME DURATION SET MONEY NUMBER ORDINAL PERCENT PERSON LOCATION ORGANIZATION MISC".split())

#: Common words of praise and of blame, for a tone by rule.
POSITIVE_WORDS = frozenset("good great best better fine happy love glad nice strong gain success win improve safe clear bright quick useful benefit".split())
NEGATIVE_WORDS = frozenset("bad worse worst poor sad hate wrong weak loss fail failure danger risk fear doubt harm slow ugly broken problem".split())

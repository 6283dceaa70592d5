"""Capitalised phrases as entities."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Capitalised words that begin sentences or name days and months, not people or things.
COMMON = frozenset(
    """A About Absolutely Actually After Ah All Already Also Although Always Amazing An And Another Any Anyway April Are Aren't As At August
Awesome Basically Be Beautiful Because Been Before Being Between Both But By Can Can't Come Coming Cool Could Couldn't December
Definitely Did Didn't Do Does Doesn't Don't During Each Even Every Exactly Fantastic February Find For Found Friday From Gave Get Give
Glad Go Going Good Got Great Had Hadn't Happy Has Hasn't Have Haven't He He's Hello Her Here Here's Hey Hi His Hmm Honestly How However
Huh I I'd I'll I'm I've If In Interesting Is Isn't It It's Its January July June Just Keep Keeping Knew Know Let's Like Look Looking
Make Making Many March May Maybe Me Might Monday More Most Much Must My Nah Need Needed Never Nice No Nope November Now October Of Often
Oh Ok Okay On Only Or Other Our Please Probably Really Right Same Saturday Saw See September She She's Should Shouldn't Since So Some
Sometimes Sorry Still Such Sunday Sure Take Taking Tell Thank Thanks That That's The Their Then There There's These They They're Think
Thinking This Those Though Thursday To Told Too Totally Try Trying Tuesday Until Very Want Wanted Was Wasn't We We're Wednesday Well
Went Were Weren't What What's When Where Which While Who Why Will With Won't Wonderful Would Wouldn't Wow Yeah Yep Yes You You're Your""".split()
)
_ENDS = re.compile(r"(?:'s)+$|(?:'t)+$|(?:'d)+$|(?:'m)+$|(?:'ll)+$|(?:'ve)+$|(?:'re)+$")


def _common(w: str) -> bool:
    size = len(w.encode())
    if size == 1:
        return not w.isupper()
    return size == 2 or w in COMMON or _ENDS.sub("", w) in COMMON


def phrases(text: str | None) -> list[str]:
    """Sorted distinct runs of capitalised words within sentences, without common ones."""
    found = set()
    for sentence in re.split(r"[.!?\n]", text or ""):
        run: list[str] = []
        for w in [*sentence.split(), ""]:
            while w and not (w[-1].isalnum() or w[-1] == "'"):
                w = w[:-1]
            if w and w[0].isupper() and not _common(w):
                run.append(w)
            elif w or run:
                if run and (w or True):
                    found.add(" ".join(run))
                run = []
    return sorted(found)


def entities(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(phrases)

    return run(text)

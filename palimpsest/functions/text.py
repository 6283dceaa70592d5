"""Text functions of ingest and query analysis, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stem import stemmed

# Words that carry no topic, in alphabetical order.
KEYWORD_STOPS = """a about above after again all also am an and are as at be because been before being below between both but by can could did does doing don
down during each even every few for from further had has have he her here him his how i in into is it its just like may me might more most
must my myself no nor not now of off on once only other our out over own same shall she should so some such than that the then there they
this through to too under up very was we were what when where which who why will with would you your""".split()
FACT_STOPS = """a about an and are as at be been being but by can could d did do does for from had has have he her his how i if in into is it its ll may me
might my no not of on or our re s shall she should t that the their them then these they this those to ve was we were what when where which
who whom why will with would you your""".split()
TERM_STOPS = """a about after all also an and any are as at back be because been but by can come could day did do does even first for from get give go good
had has have he her him his how i if in into is it its just know like look make me most my new no not now of on one only or other our out
over people say see she so some take than that the their them then there these they think this time to two up us use want was way we well
were what when which who will with work would year you your""".split()
_SPACE = "(?U)\\s+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


WORD = "(?U)[\\p{L}\\p{N}](?:\\S*[\\p{L}\\p{N}])?"  # what is left of a word without other characters at its ends


def bm25_tokens(text: Column, stem: bool = True) -> Column:
    """Lower-case words with other characters trimmed from both ends, of 2 to 50 bytes, no stop words, stemmed."""
    bare = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    kept = F.filter(bare, lambda w: F.octet_length(w).between(2, 50) & ~w.isin(KEYWORD_STOPS))
    return stemmed(kept) if stem else kept


def terms(text: Column) -> Column:
    """The distinct lower-case words of more than two bytes that aren't stop words."""
    return F.array_distinct(F.filter(words(F.lower(text)), lambda w: (F.octet_length(w) > 2) & ~w.isin(TERM_STOPS)))


def fact_words(text: Column, stem: bool = True) -> Column:
    """The distinct words compared between a query and a fact."""
    kept = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: (F.octet_length(w) > 1) & ~w.isin(FACT_STOPS))
    return F.array_distinct(stemmed(kept) if stem else kept)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Common words by the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


_UNITS = "(?:day|week|month|year)s?"
_DAYS = "|".join(("mon", "tues", "wednes", "thurs", "fri", "satur", "sun"))
_PERIOD = f"(?:week|month|year|(?:{_DAYS})day)"
RELATIVE = f"(?i)\\b(?:yesterday|tomorrow|today|tonight|(?:last|next)\\s+{_PERIOD}|(?:that|this)\\s+(?:week|month|year|morning|afternoon|evening|night)|(?:\\d+|an?|one|two|three)\\s+{_UNITS}\\s+(?:later|ago|from\\s+now))\\b"
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
ABSOLUTE = f"(?i)\\b(?:{_MONTHS})\\s+\\d{{1,2}}(?:st|nd|rd|th)?(?:,?\\s+\\d{{4}})?\\b|\\b(?:{_MONTHS})\\s+\\d{{4}}\\b|\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b|\\b\\d{{4}}[/-]\\d{{1,2}}[/-]\\d{{1,2}}\\b"
CLOCK = "(?i)\\b(?:midnight|noon|dawn|dusk|morning|afternoon|evening|night|sunset|sunrise)\\b"
VAGUE = "(?i)\\b(?:to|from|since|until|while|when|during|before|after)\\b"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _with(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _first_seen(xs: Column) -> Column:
    """Without later ones that are equal but for case."""
    return _with(xs, lambda a: _with(F.transform(a, F.lower), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def temporal_expressions(text: Column) -> Column:
    """Relative expressions, dates and times of day in that order; vague words only where there is nothing else."""
    exact = _first_seen(F.concat(*(_all(text, p) for p in (RELATIVE, ABSOLUTE, CLOCK))))
    return _with(exact, lambda e: F.when(F.size(e) > 0, e).otherwise(_first_seen(_all(text, VAGUE))))


CAUSAL = "(?i)\\b(?:because|caus(?:e[ds]?|ing)|(?:due|led|owing|thanks|attributed)\\s+to|result(?:ed)?\\s+(?:in|from)|reason(?:ed)?\\s+(?:for|that|why)|therefore|thus|hence|since|why|consequently|as\\s+a\\s+result|so\\s+that|in\\s+order\\s+to|triggered|prompted|enabled|forced|made\\s+(?:him|her|it|me|us|them)|expla(?:in(?:s|ed)?|nation))\\b"


def causal_markers(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, CAUSAL), F.lower))


def causal_density(text: Column) -> Column:
    """Words of the distinct markers by all words."""
    n = F.size(words(text))
    inside = F.aggregate(F.transform(causal_markers(text), lambda m: F.size(words(m))), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, inside / n).otherwise(0.0)


def has_causal_intent(text: Column) -> Column:
    asked = F.lower(text).rlike("^why |^how |what (?:caused|led to)|reason for|because of|due to|resulted in")
    return asked | (F.size(causal_markers(text)) > 0)


def query_type(text: Column) -> Column:
    q = F.lower(text)
    hypothetical = q.rlike("^(?:would|could|might|should) |likely|probably")
    collects = q.rlike("(?:list|show|name|tell me|what are) all|what are the|^in what ways|^how many")
    return F.when(hypothetical, "hypothetical").when(collects, "aggregation").otherwise("extraction")


_WEEKDAYS = f"(?:{_DAYS})day"
_FULL_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
TEMPORAL_SIGNS = (
    "(?i)\\b(?:tomorrow|today|yesterday)\\b",
    "(?i)\\b(?:earlier|oldest|newest|latest|recent(?:ly)?)\\b",
    "(?i)\\b(?:after|before|until|since|when)\\b",
    "(?i)\\b(?:last|next|this)\\s+week\\b",
    "(?i)\\b(?:last|next|this)\\s+month\\b",
    "(?i)\\b(?:last|next|this)\\s+year\\b",
    f"(?i)\\b(?:{_FULL_MONTHS})\\b",
    f"(?i)\\b{_WEEKDAYS}\\b",
    "(?i)\\b(?:tonight|this\\s+(?:evening|afternoon|morning))\\b",
    "(?i)\\b(?:earlier\\s+today|last\\s+night)\\b",
    "(?i)\\b\\d+\\s+(?:hour|day|week|month|year)s?\\s+ago\\b",
    "(?i)\\bpast\\s+(?:several|couple|few)\\b",
    "(?i)^(?:get|list|show)\\s+(?:newest|latest|recent)",
)
CAUSAL_SIGNS = (
    "(?i)\\b(?:reason|because|cause[ds]?|why|result\\s+in|led\\s+to)\\b",
    "(?i)\\b(?:what\\s+led\\s+to|what\\s+caused|what.*resulted\\s+in)\\b",
    "(?i)\\b(?:outcome|effect|impact|consequence)s?\\b",
    "(?i)^why\\s+",
)
ENTITY_SIGNS = (
    "(?i)\\b(?:related\\s+to|concerning|regarding|about)\\s+[A-Z]",
    "(?i)\\b(?:mention(?:ing)?|involving|with)\\s+[A-Z]",
    "\\b[A-Z][a-z]+\\b",
)
# With the group that names the entity.
LIST_SIGNS = (
    ("(?i)^what\\s+does\\s+(\\w+)\\s+(?:dislike|hate|love|need|want|prefer|enjoy|like)", 1),
    ("(?i)^what\\s+(?:were|are)\\s+(\\w+)'?s\\s+(?:routines|habits|preferences|activities|interests|hobbies)", 1),
    ("(?i)^(?:find|get|show|list)\\s+(?:everything|all)\\s+(?:regarding|for|about)\\s+(\\w+)", 1),
    ("(?i)^tell\\s+me\\s+(?:everything\\s+)?(?:regarding|about)\\s+(\\w+)", 1),
    ("(?i)^what\\s+do\\s+(?:we|i)\\s+know\\s+about\\s+(\\w+)", 1),
    ("(?i)^(\\w+)'?s\\s+(?:habits|preferences|activities|interests|hobbies)", 1),
)


def _count(text: Column, patterns) -> Column:
    return sum((F.when(text.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))


def intent(text: Column) -> Column:
    """struct(intent, confidence, temporal, causal, entity, factual, entity_focus); ties in that order."""
    t = F.least(_count(text, TEMPORAL_SIGNS) * 0.4, F.lit(1.0))
    c = F.least(_count(text, CAUSAL_SIGNS) * 0.5, F.lit(1.0))
    e = F.least(_count(text, ENTITY_SIGNS) * 0.2, F.lit(0.8))
    e = F.least(e + _count(text, [p for p, _ in LIST_SIGNS]) * 0.6, F.lit(1.0))
    f = F.lit(0.3)
    best = F.greatest(t, c, e, f)
    name = F.when(t == best, "temporal").when(c == best, "causal").when(e == best, "entity").otherwise("factual")
    caught = F.coalesce(*(F.when(F.regexp_extract(text, p, g) != "", F.regexp_extract(text, p, g)) for p, g in LIST_SIGNS))
    focus = F.when((name == "entity") & (F.length(caught) > 1), F.concat(F.upper(F.substring(caught, 1, 1)), F.substring(caught, 2, 1 << 20)))
    return F.struct(name.alias("intent"), best.alias("confidence"), t.alias("temporal"), c.alias("causal"), e.alias("entity"), f.alias("factual"), focus.alias("entity_focus"))


def secondary(i: Column) -> Column:
    """array<struct(intent, score)> of ``intent``'s other kinds above 0.3, the strongest first."""
    kinds = F.array(*(F.struct(i[k].alias("score"), F.lit(-n).alias("n"), F.lit(k).alias("intent")) for n, k in enumerate(("temporal", "causal", "entity", "factual"))))
    rest = F.sort_array(F.filter(kinds, lambda k: (k["intent"] != i["intent"]) & (k["score"] > 0.3)), asc=False)
    return F.transform(rest, lambda k: F.struct(k["intent"].alias("intent"), k["score"].alias("score")))


FIRST_PERSON = "(?i)(?<![A-Za-z0-9'])(?:i|me|my|mine|myself|i'm|i've|i'd|i'll)(?![A-Za-z0-9'])"


def third_person(content: Column, speaker: Column) -> Column:
    """First-person words about the speaker in the third person."""
    who = F.regexp_replace(speaker, "([\\\\$])", "\\\\$1")
    out = content
    for pattern, after in (
        ("(?i)\\bI'm\\b", " is"), ("(?i)\\bI've\\b", " has"), ("(?i)\\bI'll\\b", " will"), ("(?i)\\bI'd\\b", " would"),
        ("\\bI am\\b", " is"), ("\\bI have\\b", " has"), ("\\bI will\\b", " will"), ("\\bI would\\b", " would"), ("\\bI\\b", ""),
        ("(?i)\\bmyself\\b", ""), ("(?i)\\bmy\\b", "'s"), ("(?i)\\bmine\\b", "'s"), ("(?i)\\bme\\b", ""),
    ):
        out = F.regexp_replace(out, F.lit(pattern), F.concat(who, F.lit(after)))
    return out


def contextualised(content: Column, speaker: Column) -> Column:
    return F.when(F.coalesce(speaker, F.lit("")) != "", F.concat_ws(": ", speaker, content)).otherwise(content)


def whole_word(text: Column, word: Column, possessive: bool = False) -> Column:
    """Whether a word stands in a text between other characters than ASCII letters and digits, case aside."""
    quoted = F.regexp_replace(F.lower(word), "([^A-Za-z0-9 ])", "\\\\$1")
    end = "(?:['’]s)?(?![A-Za-z0-9])" if possessive else "(?![A-Za-z0-9])"
    return F.rlike(F.lower(text), F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit(end)))


def dialog_parts(dialog: Column) -> Column:
    """struct(conv, turn) of 'conversation:turn', parted at the last colon; null where it isn't one."""
    ok = dialog.rlike("^.+:-?\\d+$")
    return F.when(ok, F.struct(F.regexp_extract(dialog, "^(.+):(-?\\d+)$", 1).alias("conv"), F.regexp_extract(dialog, "^(.+):(-?\\d+)$", 2).try_cast("int").alias("turn")))


def iso_date(text: Column) -> Column:
    """yyyy-m-d as a date from 1970 on; null for dates that don't exist."""
    d = F.try_to_date(text, "yyyy-M-d")
    return F.when(text.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}$") & (F.year(d) >= 1970), d)


def shifted(at: Column, days: int) -> Column:
    """A time ``days`` later, or earlier."""
    return at + F.make_dt_interval(F.lit(days))


def day_end(at: Column) -> Column:
    """The last microsecond of a time's day."""
    return F.date_trunc("day", at).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59.999999))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def normalised_hash(content: Column) -> Column:
    """Of the content with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(content, "\\s+", " ")), 256)


def fact_key(entity: Column, kind: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", F.lower(entity), kind, F.lower(value)), 256), 1, 32)

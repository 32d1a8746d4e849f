"""Word lists of the text and gate operators."""

from __future__ import annotations

# Fixed values (results depend on exactly these words):
BM25_STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into through during is are was were be been being have has had do does did will "
    "would could should may might shall this that these those it its not no nor so yet both either each than such as also whether between within without"
).split()
# Fixed values:
KEYWORD_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might can could must to of in for on with at by from as into through "
    "during before after above below between under and but or nor not no so yet both each all any few more most other some such than too very just only also if then that this "
    "it its their they them he she we our who which what when where how there here about up out down over own same while "
    "statement statements section sections document documents documentation policy policies following contradictions contradiction contradicts commonly "
    "found inspired ambiguities common contains pairs mutually exclusive drawn realistic domains guidelines evaluation information conflicting reasoning consistency detection "
    "knowledge test purpose based including requirements required require ensures ensure according defined within without upon used using related regarding applicable appropriate "
    "necessary provided unless however therefore organization company employee employees management"
).split()
# Fixed values:
CONCEPT_STOPWORDS = (
    "the a an and or but of to for in on at with by from as is are was were be been being it its this that these those their they them has have had will would should could can may "
    "not no also than then so if while which who our we your you his her he she i me my all any some such other more most less least section report figure table page document"
).split()
# Fixed values (in addition to the list above):
CONTENT_STOPWORDS = CONCEPT_STOPWORDS + "about approximately around roughly nearly over under first second third including across throughout within according".split()
# Fixed values:
NEGATIONS = (
    "not no never none nothing neither nor without cannot can't won't shouldn't mustn't isn't aren't wasn't weren't doesn't don't didn't hasn't haven't hadn't unable fails fail failed "
    "refuses refused refuse prohibited forbidden disallowed excluded impossible"
).split()
# Fixed values:
FUNCTION_WORDS = "the a an of and or is are was were to in on at for by be been being has have had do does did will would should can could may might this that".split()
# Fixed values (first hit in this order counts):
ANTONYMS = [
    ("rose", "fell"), ("rises", "falls"), ("rising", "falling"), ("grew", "shrank"), ("grows", "shrinks"), ("growing", "shrinking"), ("increased", "decreased"), ("increases", "decreases"),
    ("expanded", "contracted"), ("expands", "contracts"), ("accelerated", "decelerated"), ("accelerates", "decelerates"), ("improved", "worsened"), ("improves", "worsens"), ("succeeded", "failed"), ("succeeds", "fails"),
    ("gained", "lost"), ("gains", "loses"), ("positive", "negative"), ("allowed", "prohibited"), ("permitted", "forbidden"), ("required", "optional"), ("mandatory", "voluntary"), ("enabled", "disabled"),
    ("active", "inactive"), ("open", "closed"), ("included", "excluded"), ("above", "below"), ("over", "under"), ("before", "after"), ("earliest", "latest"), ("higher", "lower"), ("highest", "lowest"),
    ("more", "less"), ("most", "least"), ("fastest", "slowest"), ("compliant", "non-compliant"),
]
# Fixed values:
MODALS = [("must", "must not"), ("shall", "shall not"), ("required to", "not required to"), ("permitted", "not permitted"), ("allowed to", "not allowed to")]
# Fixed values (patterns of sentences about the document itself):
META = [
    "the following contradictions", "contradictions? (?:are |is )?(?:commonly |frequently )?(?:found|embedded|inspired)", "this (?:section|document|policy|report) (?:contains|defines|covers|describes)", r"purpose:?\s", "evaluation of ",
    "each section contains", "mutually exclusive statements", r"statement [ab]\b", r"(?:contradicts?|conflicts? with) (?:statement )?[ab]\b",
]


def sql_list(words: list[str]) -> str:
    """The words as the items of a SQL list."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)

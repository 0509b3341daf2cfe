"""Problem 5: the defect of each answer that follows a question.

Refusals are found by what they repeat: openings of 24 words are candidates of each other by MinHash over shingles of five words, every
candidate is verified by its Jaccard similarity (0.8 or more), openings of the same first six words belong together, and clusters are the
connected components. A cluster that recurs over unrelated prompts is a refusal template if a tenth of its answers or more are marked as
abstained, whatever the status of the single answer says. Where a cluster does not recur, because a slot stands in its first words, the
openings of the same first four words are judged in its place. Recurrence only adds evidence: an answer marked abstained counts in any
cluster of that share, and every answer is held against a short list of common phrases. Copies, languages and endings are checked by
expressions on each pair; the words of a content are cut once and looked up.

Only distinct openings are clustered (their answers are counted before), only bands that join openings of different first words are kept,
and shingles travel as hashes. In a band every opening is first compared with one of them; only what this leaves in another component is
compared with the rest, so a template that a third of all answers open with costs one comparison for each. Bands find 99.7 % of the pairs
at a similarity of 0.8, and more above it.

Defined results: an answer pairs with every user message at the position just before it; of several pairs the first defect in order
counts; copies of a row count once; null contents count as empty; rows without id, conversation or position form no pair.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.llm.dialogues import ASSISTANT, USER, role_of, says_something
from groundline.session import checkpoint

DEFECTS = ("empty", "copy", "refusal", "language", "truncated")
OPENING, HEAD, SHORT_HEAD, SHINGLE, SIMILARITY, HASHES, ROWS = 24, 6, 4, 5, 0.8, 24, 3
#: Distinct prompts that make a template recur, and the part of its answers that must be marked as abstained.
PROMPTS, ABSTAINED = 3, 0.1
#: Words that may introduce a question that is only given back.
PREFIX_WORDS = 4

# Frequent words that tell a language from the three others; and the names of languages in a request.
WORDS = {
    "fr": "le les des du est et une dans pour que qui sur pas au aux par il ne ce où quoi quel quelle nous avec sont vous cette ou mais donc je oui non comment peux résume deux sous puis sert vaut faut sans avant dit".split(),
    "en": "the of and is to for with on that by at what how we does this it be which between as from yes why when not are can".split(),
    "de": "der die das und ist nicht mit von ein eine für auf den dem im zu wird bei nach vor wie was durchläuft gilt kostet oder aber ja nein warum welche man aus ich".split(),
    "es": "el los las del y es una por con para qué cómo según cuando lo al pero sí cuál dónde más este esta son sin bajo antes dos".split(),
}
# Letters and marks that tell a language from the three others.
LETTERS = {"fr": r"[èêçœûîàë]|\b([ldsnc]|qu)['’]", "de": "[äöüß]", "es": "[ñ¿¡áíóú]"}
NAMES = {
    "fr": "french|français|französisch|francés",
    "en": "english|anglais|englisch|inglés",
    "de": "german|allemand|deutsch|alemán",
    "es": "spanish|espagnol|spanisch|español",
}
# Common phrases of refusals in four languages, for openings that do not recur; abbreviations that no text ends with (one
# letter in small writing only: a text may end with a label such as "type P.").
CUES = (
    r"\bje (ne|n') ?(peux|puis|suis|trouve|dispose)( malheureusement)? (pas|rien)\b|\bil m'est impossible\b|\bje n'ai pas (assez|suffisamment|trouvé)\b|\bje préfère m'abstenir\b|\bje ne (peux|puis) donc (pas|rien)\b|\bnon trouvé dans\b"
    r"|\bi (can't|cannot|could not|couldn't|am not able to|am not allowed to|do not have enough|don't have enough)\b|\bi'm (unable|not able|not allowed|sorry)\b|^sorry\b|\bnot found in the\b|\boutside the scope\b|\bi would rather not\b|\bi have to pass\b"
    r"|\bkann ich (leider )?nicht\b|\bich kann (das |dazu |leider )*nicht\b|\bnicht gefunden\b|\bleider keine\b|\bfür eine antwort nicht\b"
    r"|\bno (puedo|encuentro|he encontrado)\b|\bno encontrado\b|\bqueda fuera\b|\bno basta para responder\b|\bprefiero no\b"
)
UNFINISHED = r"(^|[\s(])(pp?|págs?|[Ff]igs?|Abb|[Aa]pp|[Cc]f|[Vv]gl|nr|Nr|n°|Drs?|Dra|Prof|Mme|Mr|Mrs|Lt|e\.g|i\.e|[Pp]\. ?ex|[Pp]\. ?ej|[Zz]\. ?B|d\. ?h|c\.-à-d|[Vv]oir|[Ss]iehe|[Ss]ee|[Vv]éase|([Ll]ab|[Ss]heet|[Ee]xercise|[Qq]uestion) no|([Ss]elon|[Aa]ccording to|[Ll]aut|[Ss]egún) \p{Lu})\.$"
#: The last line of a text is the mark of a list item and nothing else.
BARE_ITEM = r"\n[ \t]*(\d{1,3}[.)]|\p{L}\)|[-*•+–])$"


@cache
def _folding() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def words_of(text: Column) -> Column:
    """The letters and digits of a text as ' word  word ', without case and Latin accents, so that word sequences can be searched."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_folding())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))


def language_of(text: Column) -> Column:
    """fr, en, de or es, whichever has most of its frequent words and own letters in the text; null if none has, or two have as many."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(lowered, r"[^\p{L}]+")
    scores = []
    for name, known in WORDS.items():
        score = F.size(F.array_intersect(words, F.array(*map(F.lit, sorted(set(known))))))  # different words; repeats tell no more
        if name in LETTERS:
            score = score + F.when(lowered.rlike(LETTERS[name]), 1).otherwise(0)
        scores.append(F.struct(score.alias("n"), F.lit(name).alias("name")))
    ranked = F.sort_array(F.array(*scores), asc=False)
    return F.when(ranked[0]["n"] > ranked[1]["n"], ranked[0]["name"])


def asked_language(question: Column) -> Column:
    """The language that a question asks its answer to be in."""
    out = F.lit(None).cast("string")
    for name, names in NAMES.items():
        out = F.when(question.rlike(rf"(?iU)\b(answer|reply|réponds|répondez|antworte|responde)\b[^:]{{0,20}}\b({names})\b"), name).otherwise(out)
    return out


def is_copy(question: Column, answer: Column) -> Column:
    """The answer holds the question, once or more, and besides it at most a few introducing words."""
    left = F.replace(answer, question, F.lit(""))
    return (F.length(F.trim(question)) > 0) & F.contains(answer, question) & (F.regexp_count(left, F.lit(r"\S+")) <= PREFIX_WORDS)


def is_truncated(answer: Column) -> Column:
    """The text stops inside a code block, a formula, a bracket or a sentence, or at the mark of an empty list item."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)(\s*\[\d+(,\s*\d+)*\])*\s*$", "")
    odd = lambda mark: F.regexp_count(text, F.lit(mark)) % 2 == 1
    ended = text.rlike(r"[.!?…。！？؟।][\s»”\"“‟’'」』)\]*_]*$") | text.rlike(r"(```|\$|\|)$")
    bare = text.rlike(r"^\s*[\d.,%°\s-]+$") | text.rlike(r"(?i)^\s*(oui|non|yes|no|ja|nein|sí)\s*$")
    return odd("```") | odd(r"\$") | odd(r"\$\$") | text.rlike(BARE_ITEM) | (F.regexp_count(text, F.lit(r"\(")) > F.regexp_count(text, F.lit(r"\)"))) | (~ended & ~bare) | text.rlike(UNFINISHED)


def answer_pairs(messages: DataFrame) -> DataFrame:
    """(message_id, prompt, opening, abstained, cue and a flag for each plain defect) of every pair; contents do not go beyond the join."""
    rows = messages.filter("conversation_id is not null and position is not null").select("id", "conversation_id", "position", "content", F.col("payload.status").alias("status"), role_of(F.col("role")).alias("role"))
    answers = rows.filter((F.col("role") == ASSISTANT) & F.col("id").isNotNull()).select(
        F.col("id").alias("message_id"),
        "conversation_id",
        (F.col("position") - 1).alias("position"),
        words_of(F.col("content")).alias("answer"),
        language_of(F.col("content")).alias("answered_in"),
        is_truncated(F.col("content")).alias("truncated"),
        (~says_something(F.col("content"))).alias("empty"),
        F.lower("content").rlike(CUES).alias("cue"),
        F.coalesce(F.col("status") == "abstained", F.lit(False)).alias("abstained"),
    )
    prompts = rows.filter(F.col("role") == USER).select("conversation_id", "position", words_of(F.col("content")).alias("question"), language_of(F.col("content")).alias("asked_in"), asked_language(F.col("content")).alias("wanted"))
    both = answers.join(prompts, ["conversation_id", "position"])
    return both.select(
        "message_id",
        F.xxhash64("question").alias("prompt"),
        F.array_join(F.slice(F.split(F.regexp_replace(F.trim("answer"), r"\d+", "0"), " +"), 1, OPENING), " ").alias("opening"),
        "abstained",
        F.coalesce("cue", F.lit(False)).alias("cue"),
        "empty",
        is_copy(F.col("question"), F.col("answer")).alias("copy"),
        F.coalesce((F.col("answered_in") != F.col("asked_in")) & ~F.col("answered_in").eqNullSafe(F.col("wanted")), F.lit(False)).alias("language"),
        "truncated",
    )


def shingles(opening: Column) -> Column:
    """Hashes of the distinct runs of five words of an opening; a shorter opening is one shingle."""
    words = F.split(opening, " ")
    count = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))


def components(edges: DataFrame) -> DataFrame:
    """(node, cluster): the least node of the connected component of each node of the edges (a, b)."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("cluster")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("near"))
        new = checkpoint(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("cluster", "near").alias("cluster"), (F.col("near") < F.col("cluster")).alias("moved")))
        labels = new.select("node", "cluster")
        if not new.filter("moved").take(1):
            return labels


def clustered(openings: DataFrame) -> DataFrame:
    """(opening, cluster): openings of the same first words, and those joined by a pair of openings that passes the Jaccard check."""
    signed = openings.select("opening", F.substring_index("opening", " ", HEAD).alias("head"), shingles(F.col("opening")).alias("s"))
    # no default argument: transform() would take a second parameter of the function for the place in the array
    least_hash = lambda k: F.array_min(F.transform("s", lambda x: F.xxhash64(F.lit(k), x)))
    bands = [F.xxhash64(*[least_hash(k) for k in range(b, b + ROWS)], F.lit(b)) for b in range(0, HASHES, ROWS)]
    slim = checkpoint(signed.select(F.xxhash64("opening").alias("o"), F.xxhash64("head").alias("h"), F.explode(F.array(*bands)).alias("bucket")))
    mixed = slim.groupBy("bucket").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("bucket")
    near = slim.join(mixed, "bucket").join(signed.select(F.xxhash64("opening").alias("o"), "head", "s"), "o").select("bucket", "head", "s")
    near = checkpoint(near)
    joint = F.size(F.array_intersect("s", "s2")) / F.size(F.array_union("s", "s2"))
    first = near.groupBy("bucket").agg(F.min(F.struct("head", "s")).alias("_")).select("bucket", F.col("_.head").alias("head2"), F.col("_.s").alias("s2"))
    to_first = near.join(first, "bucket").filter((F.col("head") != F.col("head2")) & (joint >= SIMILARITY)).select(F.col("head2").alias("a"), F.col("head").alias("b")).distinct()
    to_first = checkpoint(to_first)
    found = components(to_first)
    of = lambda c: F.coalesce(c, F.col("head"))
    placed = near.join(found, F.col("head") == F.col("node"), "left").select("bucket", "head", "s", of(F.col("cluster")).alias("c"))
    anchor = first.join(found, F.col("head2") == F.col("node"), "left").select("bucket", F.coalesce("cluster", "head2").alias("main"))
    apart = placed.join(anchor, "bucket").filter("c <> main").select("bucket", F.col("head").alias("head2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    rest = placed.join(apart, "bucket").filter((F.col("c") != F.col("c2")) & (joint >= SIMILARITY)).select(F.col("head").alias("a"), F.col("head2").alias("b")).distinct()
    rest = checkpoint(rest)
    if not rest.isEmpty():
        found = components(to_first.unionByName(rest))
    return signed.join(found, F.col("head") == F.col("node"), "left").select("opening", of(F.col("cluster")).alias("cluster"))


def templates(openings: DataFrame) -> DataFrame:
    """(opening, marked, recurs) of openings (opening, n, a, prompts): whether its cluster, or else its first four words, recur over
    prompts, and whether a tenth of the answers are marked as abstained there."""
    rate = (F.sum("a") / F.sum("n")).alias("rate")
    named = openings.join(clustered(openings), "opening").withColumn("short", F.substring_index("opening", " ", SHORT_HEAD))
    totals = named.groupBy("cluster").agg(rate, F.sum("prompts").alias("asked"))
    short = named.groupBy("short").agg(rate.alias("short_rate"), F.sum("prompts").alias("short_asked"))
    both = named.join(totals, "cluster").join(short, "short")
    own = F.col("asked") >= PROMPTS
    return both.select("opening", (F.when(own | (F.col("short_asked") < PROMPTS), F.col("rate")).otherwise(F.col("short_rate")) >= ABSTAINED).alias("marked"), (own | (F.col("short_asked") >= PROMPTS)).alias("recurs"))


def defects(messages: DataFrame) -> DataFrame:
    """(message_id, defect) of every answer with a defect."""
    pairs = checkpoint(answer_pairs(messages))
    answers = pairs.groupBy("opening", "message_id").agg(F.min("prompt").alias("prompt"), F.max("abstained").alias("abstained"))
    counted = answers.groupBy("opening", "prompt").agg(F.count("*").alias("n"), F.count_if("abstained").alias("a"))
    openings = checkpoint(counted.groupBy("opening").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.count("*").alias("prompts")))
    judged = pairs.join(templates(openings), "opening")
    refusal = F.col("cue") | (F.col("marked") & (F.col("recurs") | F.col("abstained")))
    rank = F.lit(None).cast("int")
    for number, flag in reversed(list(enumerate([F.col("empty"), F.col("copy"), refusal, F.col("language"), F.col("truncated")]))):
        rank = F.when(flag, number).otherwise(rank)
    first = judged.select("message_id", rank.alias("rank")).groupBy("message_id").agg(F.min("rank").alias("rank")).filter("rank is not null")
    return first.select("message_id", F.element_at(F.array(*map(F.lit, DEFECTS)), F.col("rank") + 1).alias("defect"))

"""Medical conversations: which are personal consultations, what their annotations say, and stratified samples of their turns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import nfkc
from colloquy.operators.dedup import tokens

# Words that must be the surveyed ones for the same decisions.
#: Requests for texts, games, schoolwork or plans, which are no consultations.
TASKS = (
    r"(?:summari[sz]e|summery|summerize)\s+(?:this|the following)\b",
    r"(?:summari[sz]e|summery|summerize|draw a summary|rewrite|translate|proofread|paraphrase|improve|shorten|rephrase).{0,60}(?:passage|text|sentence|email|article|abstract|paper|resume|paragraph)",
    r"(?:write|writing|working on|create|make|generate|draft|prepare|edit|help (?:me )?(?:write|make|create|draw)).{0,80}(?:script|screenplay|comic|manga|novel|article|essay|fiction|story|lyrics|poem|website|slides?|presentation|powerpoint|resume|email|character|faqs?|report|summary|expression|prompt|text|letter|content)",
    r"(?:exam|quiz|multiple[- ]choice|group of answer choices|homework)",
    r"(?:text[- ]based adventure|role ?play|dating expert|content writer|sci[- ]?fi|fictional|flowchart image|find (?:a )?(?:city|neighbou?rhood)|professional summarizer|pretend to be (?:a )?(?:famous )?author|risk of bias|check grammar|correct (?:the )?grammar|youtube shorts?|ai agent|doctor who|write (?:a )?(?:follow[- ]?up|sequel))",
    r"(?:weekly meal plan|meal planning|workout plan|fitness plan)",
)
#: Things that texts are about when they are no consultations.
SUBJECTS = "research (?:paper|study|article)|journal article|abstract|passage|chapter|book i'm writing|comic|novel|story|video game|horror game|zombie outbreak|employee survey|presentation|powerpoint|flowchart|case study|student nurse|clinical placement|nursing documentation|competency assessment programme|fabric features?|product features?"
PRONOUNS = "i|i've|i'm|i'd|me|my|mine|we|we've|we're|our|my (?:child|son|daughter|mother|father|partner|husband|wife)"
ACTIONS = "have|had|feel|feeling|felt|experience|experiencing|suffer|suffering|diagnosed|taking|take|developed|started|worsening|getting worse|tested positive|tested negative|hurt|hurts"
CLINICAL = "symptoms?|pain|ache|cough|fever|headache|nausea|dizz(?:y|iness)|medications?|medicine|breath(?:ing|lessness)?|rash|infection|bleeding|vomit(?:ing)?|diarrh(?:ea|oea)|swelling|allerg(?:y|ies|ic)|blood pressure|heart rate|diagnosed|diagnosis|sore|burning|hurts?|anxiety|depression|ocd|autism"
DIRECT = "should (?:i|we) (?:see|contact|visit)|what (?:could|might) (?:this|these symptoms) be|(?:my|our) (?:doctor|medication|medicine|symptoms?|pain)|give (?:your|me) (?:a )?view on my symptoms|what kind of illness (?:i|we) (?:have|might have)"
#: How questions of knowledge begin.
KNOWLEDGE = ("what is ", "what are ", "explain ", "define ", "tell me about ", "how does ")
#: Advice that nobody should give: doses changed or set, certain diagnoses, no doctor.
UNSAFE = (
    r"(?i)\b(?:stop|discontinue|double|triple)\s+(?:taking\s+)?(?:your\s+)?(?:medication|medicine|dose|insulin|warfarin)\b",
    r"(?i)(?:^|[.!?]\s*)(?:please\s+)?take\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\b|\b(?:you\s+should|you\s+must)\s+take\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml)\b",
    r"(?i)\b(?:definitely|certainly)\s+(?:have|is)\b",
    r"(?i)\b(?:no need|do not need|don't need)\s+to\s+(?:see|contact|visit)\s+(?:a\s+)?(?:doctor|clinic|hospital)\b",
    r"(?:薬|服用|投薬).{0,12}(?:中止|倍量|2倍|３倍|3倍)",
    r"(?i)\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml).{0,12}(?:(?:飲んで|服用して|投与して)(?:ください|下さい)|(?:飲む|服用する|投与する)べき)",
    r"(?:間違いなく|確実に).{0,8}(?:です|病気|疾患)",
    r"(?:受診|医師|病院).{0,10}(?:必要ありません|不要です|行かなくて)",
)
#: Characters of a turn that are looked at, of an opening that may stand without a direct question, and within which the signs lie.
SEEN, LONG_OPENING, NEAR = 2000, 1200, 180
#: Turns with so many words have substance; of those the first few may open a consultation.
SUBSTANCE_WORDS, OPENINGS = 4, 3


def any_word(words: str) -> str:
    """A pattern for whole words or phrases, any case."""
    return rf"(?i)\b(?:{words})\b"


def keywords(words: tuple[str, ...]) -> str:
    """Whole words of a list, with any white space between parts."""
    if not words:
        return r"(?!)"
    # a boundary only where the word ends in a letter or digit
    each = ((r"(?<![A-Za-z0-9_])" if w[0].isalnum() else "") + r"\s+".join(map(re.escape, w.split())) + (r"(?![A-Za-z0-9_])" if w[-1].isalnum() else "") for w in words)
    return "(?i)(?:" + "|".join(each) + ")"


def place(text: Column, pattern: str) -> Column:
    """Where the first match begins, from 1; 0 without one."""
    return F.regexp_instr(text, F.lit(pattern))


def opens_consultation(text: Column, domain: str) -> Column:
    """A turn of the domain that asks directly, or names a person, what happens to them and a clinical term close together."""
    places = [place(text, any_word(x)) for x in (PRONOUNS, ACTIONS, CLINICAL)]
    close = reduce(lambda a, b: a & b, [p > 0 for p in places]) & (F.greatest(*places) - F.least(*places) <= NEAR)
    return text.rlike(domain) & (text.rlike(any_word(DIRECT)) | close)


def personal_consultation(turns: DataFrame, key: str, order: str, domain_words: tuple[str, ...]) -> DataFrame:
    """turns: key, order, role, text. Returns key, consultation for each conversation.

    A conversation with any request for a text or the like is none. The first turn of substance may be neither long nor quoted
    unless it asks directly; one of the first three must open a consultation. Conversations without user turns are none; a null
    text counts as empty. Turns are looked at in their compatibility form; substance is four different words of ASCII letters and digits.
    """
    text = nfkc(F.substring(F.coalesce("text", F.lit("")), 1, SEEN))
    user = turns.where("role = 'user'").select(key, order, text.alias("seen")).withColumn("whole", F.regexp_replace("seen", r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    domain, direct = keywords(domain_words), any_word(DIRECT)
    words = F.size(tokens(F.col("whole")))
    judged = user.select(
        key, order,
        (F.col("seen").rlike(any_word("|".join(TASKS))) | F.col("seen").rlike(any_word(SUBJECTS))).alias("task"),
        (words >= SUBSTANCE_WORDS).alias("substance"),
        (((F.length("whole") > LONG_OPENING) | F.col("whole").rlike('^["“]')) & ~F.col("seen").rlike(direct)).alias("barred"),
        opens_consultation(F.col("whole"), domain).alias("opens"),
    )
    ranked = judged.withColumn("nth", F.when(F.col("substance"), F.sum(F.col("substance").cast("int")).over(Window.partitionBy(key).orderBy(order))))
    found = ranked.groupBy(key).agg(
        F.bool_or("task").alias("task"), F.coalesce(F.bool_or((F.col("nth") == 1) & F.col("barred")), F.lit(False)).alias("barred"), F.coalesce(F.bool_or((F.col("nth") <= OPENINGS) & F.col("opens")), F.lit(False)).alias("opens")
    )
    conversations = turns.select(key).distinct()
    return conversations.join(found, key, "left").select(key, F.coalesce(~F.col("task") & ~F.col("barred") & F.col("opens"), F.lit(False)).alias("consultation"))


@dataclass(frozen=True)
class HealthLists:
    """Words of the domain, of its respiratory part, of patients' reports and of abuse, and patterns of personal data."""

    domain: tuple[str, ...]
    respiratory: tuple[str, ...] = ()
    reports: tuple[str, ...] = ()
    abuse: tuple[str, ...] = ()
    personal_data: tuple[str, ...] = ()


def health_flags(turns: DataFrame, key: str, order: str, lists: HealthLists) -> DataFrame:
    """turns: key, order, role, text. Returns key, and for each conversation: health, respiratory, personal, followup_information, single_knowledge, explicit_pii, toxic_text.

    health and respiratory look at the first 2000 characters of each user turn, put together; followup_information at user
    turns after the first that hold three different words and a report, a word of the domain or the speaker; personal data
    and abuse at all turns. A question of knowledge is one that is no personal consultation. Null texts are empty.
    """
    text = F.coalesce("text", F.lit(""))
    said = F.array_sort(F.collect_list(F.struct(order, "role", text.alias("text"))))
    rows = turns.groupBy(key).agg(said.alias("said")).withColumn("user", F.transform(F.filter("said", lambda x: x["role"] == "user"), lambda x: x["text"]))
    seen, whole = F.array_join(F.transform("user", lambda x: F.substring(x, 1, SEEN)), " "), F.array_join(F.transform("said", lambda x: x["text"]), " ")
    domain, reports = keywords(lists.domain), keywords(lists.reports)
    follows = F.exists(F.slice("user", 2, F.greatest(F.size("user"), F.lit(1))), lambda x: (F.size(tokens(x)) >= 3) & (x.rlike(reports) | x.rlike(domain) | x.rlike(any_word("i|my|me|mine"))))
    first = F.lower(F.regexp_replace(F.coalesce(F.get("user", F.lit(0)), F.lit("")), r"^[\s\x1c-\x1f]+", ""))
    data = reduce(lambda a, b: a | b, (F.col("whole").rlike(f"(?i){x}") for x in lists.personal_data), F.lit(False))
    rows = rows.select(key, seen.alias("seen"), whole.alias("whole"), follows.alias("followup_information"), reduce(lambda a, b: a | b, (first.startswith(x) for x in KNOWLEDGE)).alias("asks"))
    both = rows.join(personal_consultation(turns, key, order, lists.domain).withColumnRenamed("consultation", "personal"), key)
    health = F.col("seen").rlike(domain)
    return both.select(
        key, health.alias("health"), (health & F.col("seen").rlike(keywords(lists.respiratory))).alias("respiratory"), "personal", "followup_information",
        (F.col("asks") & ~F.col("personal")).alias("single_knowledge"), data.alias("explicit_pii"), F.col("whole").rlike(keywords(lists.abuse)).alias("toxic_text"),
    )


def unsafe_advice(text: Column) -> Column:
    """Whether a text holds plainly dangerous advice; null: no."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.rlike(x) for x in UNSAFE)), F.lit(False))


def annotation_summary(annotations: DataFrame, conversation: str, turn: str) -> DataFrame:
    """annotations: conversation, turn, variant, intent, slot (a row each; null: none). Returns kind, name, n: how often each intent and slot stands there, and the turns whose variants differ."""
    named = annotations.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.lower(F.trim(c)).alias("name")) for c in ("intent", "slot")))).alias("x")).where("x.name <> ''")
    counted = named.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    # what a variant says of a turn, in order
    said = annotations.groupBy(conversation, turn, "variant").agg(F.to_json(F.array_sort(F.collect_list(F.struct("intent", "slot")))).alias("said"))
    differ = said.groupBy(conversation, turn).agg(F.count_distinct("said").alias("said")).agg(F.count_if(F.col("said") > 1).alias("n"))
    return counted.unionByName(differ.select(F.lit("disagreement").alias("kind"), F.lit("turns").alias("name"), "n"))


def aligned_annotations(utterances: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """utterances, annotations: key, items (arrays). Returns key, problem: 'missing annotations', 'missing utterances' or 'lengths differ' for each key that can't be aligned."""
    both = utterances.select(key, F.size("items").alias("u")).join(annotations.select(key, F.size("items").alias("a")), key, "full")
    problem = F.when(F.col("a").isNull(), "missing annotations").when(F.col("u").isNull(), "missing utterances").when(F.col("u") != F.col("a"), "lengths differ")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def merged_variants(dialogues: DataFrame, digest: str, key: str) -> DataFrame:
    """Dialogues of one content as one row: digest, the smallest key, all keys in order, how many were merged away."""
    return dialogues.groupBy(digest).agg(F.min(key).alias("representative"), F.array_sort(F.collect_list(key)).alias("members"), (F.count("*") - 1).alias("merged"))


def official_splits(groups: DataFrame, digest: str, outside: str, seed: str, sizes: tuple[int, int]) -> DataFrame:
    """digest, split: those outside the domain are test; the others in the order of a seeded hash: so many train, so many validation, the rest test."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(digest).cast("string")), 256)
    inside = groups.where(~F.col(outside)).select(digest, order.alias("o"))
    # only the first few of the order are numbered, as many as the splits hold
    first = inside.orderBy("o").limit(sum(sizes)).withColumn("k", F.row_number().over(Window.orderBy("o")))
    cut = first.agg(F.max(F.when(F.col("k") <= sizes[0], F.col("o"))).alias("train"), F.max("o").alias("validation"))
    split = F.when(F.col(outside), "test").when(F.col("o") <= F.col("train"), "train").when(F.col("o") <= F.col("validation"), "validation").otherwise("test")
    return groups.withColumn("o", order).join(F.broadcast(cut)).select(digest, split.alias("split"))

"""Expressions on chat messages: intents, moods, clean-ups, screening."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: messages and first words that are small talk
SMALLTALK = ["hi", "hii", "hiii", "hello", "helo", "hey", "heyy", "yo", "hiya", "good morning", "good afternoon", "good evening", "gm", "ge", "thanks", "thank you",
             "thankyou", "thx", "ty", "cheers", "ok", "okay", "cool", "nice", "great", "bye", "goodbye", "see you", "how are you", "how are you?", "whatsup", "what's up", "sup"]
GREETING_WORDS = ["hi", "hello", "hey", "yo", "thanks", "thank", "bye", "hiya", "sup"]

# fixed values: strings that hint at a mood
MOOD_SIGNALS = ["useless", "terrible", "worst", "ridiculous", "annoy", "frustrat", "angry", "unacceptable", "complaint", "complain", "refund", "cancel", "manager", "human", "agent",
                "supervisor", "speak to", "talk to", "real person", "stupid", "hate", "sick of", "fed up", "waste", "scam", "cheat", "rip off", "not working", "doesn't work",
                "still not", "again", "third time", "3rd time", "urgent", "asap", "immediately", "disappointed", "poor service", "never", "fk", "wtf", "damn", "shit", "hell"]

# fixed values: strings of an answer that doesn't know
UNCERTAIN = ["don't have enough information", "i don't know", "cannot answer", "not sure", "don't have that information", "insufficient information", "unable to answer", "can't find",
             "not available", "connect you with a human", "escalate to", "research this further"]

# fixed values: words that point back, and what the last question was about (first rule that fits; the level rules exclude each other)
PRONOUNS = ["it", "that", "this", "these", "those", "them", "his", "her", "their", "about"]
VAGUE = ["results", "details", "information", "more", "other"]
ENTITIES = [
    (r"ordinary level|o-?level|o/l", "Ordinary Level results"), (r"advanced level|a-?level|a/l", "Advanced Level results"), (r"education|degree|university|school|college", "education"),
    (r"work|job|employment|career", "work experience"), (r"skills|technical|competencies", "skills"), (r"volunteer|extracurricular|organizing", "volunteering"),
    (r"projects|portfolio|built|developed", "projects"),
]

# fixed values: phrases that cite the context, removed in this order
CITATIONS = [
    r"According to \[Context \d+\],?\s*", r"Based on \[Context \d+\],?\s*", r"As mentioned in \[Context \d+\],?\s*", r"From \[Context \d+\],?\s*", r"In \[Context \d+\],?\s*",
    r"\[Context \d+\] states that\s*", r"\[Context \d+\] mentions that\s*", r"\[Context \d+\] indicates that\s*", r"\[Source \d+\],?\s*",
    r"According to the (provided )?context,?\s*", r"Based on the (provided )?context,?\s*", r"From the (provided )?context,?\s*",
]

# fixed values: code point ranges of pictographs, arrows, selectors
EMOJI = [(0x1F000, 0x1FAFF), (0x2600, 0x27BF), (0x1F1E6, 0x1F1FF), (0x2190, 0x21FF), (0x2B00, 0x2BFF), (0xFE00, 0xFE0F), (0x200D, 0x200D), (0x24C2, 0x24C2), (0x2122, 0x2122), (0x3030, 0x3030)]
EMOJI_CLASS = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in EMOJI) + "]+"

# fixed values: attack and secret patterns
SUSPICIOUS = [r"(\bunion\b.*\bselect\b|\bselect\b.*\bfrom\b)", r"(<script|javascript:|onerror=|onload=)", r"(\.\./|\.\.\\|%2e%2e)", r"(exec\(|eval\(|system\(|passthru\()"]
SECRETS = {"Groq API Key": r"gsk_[a-zA-Z0-9]{50,}", "OpenAI Key": r"sk-[a-zA-Z0-9]{40,}", "Generic Secret": r"(?i)(secret|password|api[_-]?key)\s*=\s*[\"'][^\"']{16,}[\"']",
           "AWS Key": r"AKIA[0-9A-Z]{16}", "Private Key": r"-----BEGIN (RSA |)PRIVATE KEY-----"}

# fixed values: tone of an answer by mood
MOODS = {
    "angry": "The customer sounds ANGRY. Open with a sincere, brief apology. Stay calm and non-defensive. Focus entirely on resolving their issue. Do not be cheerful or salesy.",
    "frustrated": "The customer sounds FRUSTRATED. Acknowledge their frustration, be extra clear and efficient, and don't make them repeat themselves.",
    "confused": "The customer sounds CONFUSED. Slow down, explain simply and step by step, and check they're following.",
    "happy": "The customer is in a good mood — match their warmth.",
}
MOOD_HUMAN = ("The customer explicitly asked for a human — call the escalate_to_human tool NOW (write a short summary of the conversation), then warmly tell them a human agent will follow up. "
              "Do not just ask for more details first.")
MOOD_OFFER = "If you cannot fully resolve this, sincerely offer to connect them to a human agent and use the escalate_to_human tool."
MOOD_INTRO = "\n\nCUSTOMER MOOD (adapt your tone):\n- "

# fixed values: requests a minute by part of the path; the first that fits
LIMITS = {"/api/clients/": 60, "/api/query": 30, "/api/chat": 30, "/api/documents/upload": 10, "/health": 120}
LIMIT_ELSE = 60


def _any_of(strings: list[str]) -> str:
    return "|".join(re.escape(s).replace(r"\ ", " ").replace(r"\'", "'") for s in strings)


def _strip(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def is_smalltalk(message: Column) -> Column:
    t = F.regexp_replace(F.lower(_strip(F.coalesce(message, F.lit("")))), r"[!.?]+$", "")
    parts = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return (F.coalesce(message, F.lit("")) == "") | t.isin(SMALLTALK) | ((F.size(parts) <= 2) & F.coalesce(F.get(parts, F.lit(0)).isin(GREETING_WORDS), F.lit(False)))


def needs_mood_check(message: Column) -> Column:
    """A signal word, emphatic punctuation, or a word of four letters or more in capitals."""
    m = F.coalesce(message, F.lit(""))
    loud = F.exists(F.split(m, r"\s+"), lambda w: (F.char_length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 4) & (F.upper(F.regexp_replace(w, r"[^\p{L}]", "")) == F.regexp_replace(w, r"[^\p{L}]", ""))
                    & (F.lower(w) != w))
    return F.lower(m).rlike(_any_of(MOOD_SIGNALS)) | m.rlike(r"(?s)!!|\?\?|\?!|!.*!") | loud


def is_uncertain(answer: Column) -> Column:
    return F.lower(F.coalesce(answer, F.lit(""))).rlike(_any_of(UNCERTAIN))


def mood_directive(emotion: Column, intensity: Column, wants_human: Column) -> Column:
    tone = F.coalesce(*(F.when(emotion == name, F.lit(text)) for name, text in MOODS.items()))
    then = F.when(F.coalesce(wants_human, F.lit(False)), F.lit(MOOD_HUMAN)).when(emotion.isin("angry", "frustrated") & (F.coalesce(intensity, F.lit(1)) >= 4), F.lit(MOOD_OFFER))
    lines = F.array_compact(F.array(tone, then))
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.concat(F.lit(MOOD_INTRO), F.array_join(lines, "\n- ")))


def points_back(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    words = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS))) | q.rlike("|".join(VAGUE))


def expand_with_history(query: Column, last_question: Column) -> Column:
    """``query`` with the subject of the last question among the three messages before, if it points back."""
    edge = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    subject = F.coalesce(*(F.when(last_question.rlike(f"(?i){edge[0]}({p}){edge[1]}"), F.lit(name)) for p, name in ENTITIES))
    return F.when(points_back(query) & subject.isNotNull(), F.concat(query, F.lit(" "), subject)).otherwise(query)


def strip_emoji(text: Column) -> Column:
    t = F.regexp_replace(text, EMOJI_CLASS, "")
    return _strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"\s+([,.!?])", "$1"))


def strip_markdown(text: Column) -> Column:
    """Text to be spoken: fences, code marks, links, headings, bullets and emphasis go, then emoji."""
    t = F.coalesce(text, F.lit(""))
    for pattern, to in [(r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?md)^\s{0,3}#{1,6}\s*", ""), (r"(?md)^\s*[-*+]\s+", ""),
                        (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"), (r"[*_#>`]", "")]:
        t = F.regexp_replace(t, pattern, to)
    return _strip(F.regexp_replace(F.regexp_replace(strip_emoji(t), r"[ \t]+", " "), r"\n{2,}", "\n"))


def clean_citations(answer: Column) -> Column:
    t = answer
    for pattern in CITATIONS:
        t = F.regexp_replace(t, "(?i)" + pattern, "")
    t = _strip(F.regexp_replace(t, "  +", " "))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 2**31 - 1))


def sanitize_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("**"), F.lit("*")), F.lit("__"), F.lit("_"))


def script(text: Column) -> Column:
    """``si`` if a Sinhala character occurs, else ``ta`` for Tamil, else null."""
    return F.when(text.rlike(r"[\x{0D80}-\x{0DFF}]"), "si").when(text.rlike(r"[\x{0B80}-\x{0BFF}]"), "ta")


def is_noise(transcript: Column) -> Column:
    return F.regexp_replace(F.coalesce(transcript, F.lit("")), r"[^\p{L}\p{N}_]", "") == ""


def is_suspicious(text: Column) -> Column:
    found = F.lit(False)
    for p in SUSPICIOUS:
        found = found | text.rlike("(?i)" + p)
    return found


def secret_kinds(line: Column) -> Column:
    return F.array_compact(F.array(*(F.when(line.rlike(p), F.lit(name)) for name, p in SECRETS.items())))


def within_input_limit(text: Column, most: int = 7000) -> Column:
    return F.floor(F.char_length(text) / 4) <= most


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[a-zA-Z0-9_-]+$")


def rate_limit(path: Column) -> Column:
    out = F.lit(LIMIT_ELSE)
    for part, limit in reversed(LIMITS.items()):
        out = F.when(F.contains(path, F.lit(part)), F.lit(limit)).otherwise(out)
    return out


def reference_key(text: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def user_prompt(query: Column, passages: Column) -> Column:
    """Passages between rules, then the question."""
    return F.concat(F.lit("Information:\n"), F.array_join(passages, "\n\n---\n\n"), F.lit("\n\nQuestion: "), query)

"""Text cleaning, structure and word expressions, all on the JVM.

``\\w`` of the specification covers letters, digits and underscores of every script, so classes are
written out.  Multi-line patterns use Unix lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"

# fixed values: words that are no keywords
STOPWORDS = """a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would
could should may might must shall can need this that these those i you he she it we they what which who whom whose where when why how
all each every both few more most other some such no nor not only own same so than too very just also now here there then once if
because until while about into through during before after above below between under over out up down off any its your their our my
his her me him them us am being etc however therefore thus hence yet still already even though although whether either neither much
many several get got getting let lets say said says like make made take took""".split()

# fixed values: patterns of headings (group 1 is the heading), lists, tables and code
HEADINGS = [r"^#{1,3}\s+(.+)$", r"^([A-Z][A-Za-z\s]+):?\s*$", r"^(\d+\.?\s+[A-Z][A-Za-z\s]+)$", r"^([A-Z][A-Z\s]+)$", r"^(Chapter\s+\d+[:\s].+)$", r"^(Section\s+\d+[:\s].+)$"]
LIST_ITEM = r"^\s*([-•*]|\d+[.)]|[a-z][.)])[ \t]+"
TABLE_ROW, TABLE_RULE = r"\|.+\|", r"^\s*[-+]+\s*$"
CODE = r"```[\s\S]*?```|`[^`]+`"

# fixed values: kinds of sections by the start of their first line, and their words
SECTIONS = {
    "work_experience": r"work\s+experience|employment\s+history|professional\s+experience|career\s+history|experience",
    "education": r"education|academic\s+background|qualifications|educational\s+background",
    "skills": r"skills|technical\s+skills|competencies|expertise|core\s+competencies",
    "volunteer": r"volunteer|volunteering|community\s+service|extracurricular",
    "projects": r"projects|key\s+projects|portfolio|personal\s+projects",
    "certifications": r"certifications|certificates|licenses|credentials",
    "summary": r"summary|profile|objective|about\s+me|professional\s+summary",
    "contact": r"contact|contact\s+information|personal\s+details",
}

# fixed values: words that don't end a sentence with their full stop
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "i.e", "e.g", "Inc", "Ltd", "Corp", "Co", "No", "Vol", "Rev", "Gen", "Col", "Fig", "al", "cf", "eg", "ie", "et"]

# fixed values: question patterns
QUESTIONS = ["What is {}?", "How does {} work?", "Tell me about {}", "Explain {}", "What are the details of {}?"]


# fixed values: the cleaning steps, in order; flags, pattern, replacement ({1}: first group)
OCR = [("", rf"({W}+)-\s*\n\s*({W}+)", "{1}{2}"), ("", "  +", " "), ("", rf"({W})\n({W})", "{1} {2}"), ("", "[–—]", "-"), ("", "…", "...")]
SPACES = [("", r"\n{3,}", "\n\n"), ("", r"[ \t]+", " "), ("", r" *\n *", "\n")]
PAGE_NUMBERS = [("i", r"\n\s*(?:Page\s*)?\d+\s*(?:of\s*\d+)?\s*\n", "\n"), ("m", r"^\s*\d{1,3}\s*$", "")]
CONTENTS = [("im", r"^Table\s+of\s+Contents?\s*\n", ""), ("m", r"^.+\.{3,}\s*\d+\s*$", "")]

#: A sentence's last word (group 1), before a capitalised one, in a text of single blanks.
SENTENCE_END = rf"(?<=^| )(?!(?:{'|'.join(a.replace('.', chr(92) + '.') for a in ABBREVIATIONS)})[.!?]+ )([^ ]*[.!?]) (?=\p{{Lu}})"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def replaced(text: Column, steps: list[tuple[str, str, str]]) -> Column:
    for flags, pattern, to in steps:
        text = F.regexp_replace(text, f"(?d{flags}){pattern}", to.format("$0", "$1", "$2"))
    return text


def fix_ocr(text: Column) -> Column:
    """Joins words broken at line ends, collapses blanks, joins lines broken inside a sentence, plain dashes."""
    return replaced(text, OCR)


def normalize_whitespace(text: Column) -> Column:
    return replaced(text, SPACES)


def remove_page_numbers(text: Column) -> Column:
    return replaced(text, PAGE_NUMBERS)


def remove_contents(text: Column) -> Column:
    return replaced(text, CONTENTS)


def clean(text: Column) -> Column:
    """All cleaning steps in order; text must be in NFKC already (``models.nfkc`` does that)."""
    return strip(replaced(F.coalesce(text, F.lit("")), [*OCR, *SPACES, *PAGE_NUMBERS, *CONTENTS]))


def token_count(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def truncate_tokens(text: Column, most: int) -> Column:
    return F.left(text, F.lit(4 * most))


def heading(line: Column) -> Column:
    """The heading that a line of up to 100 characters states, else null."""
    s = strip(line)
    found = F.coalesce(*(F.nullif(F.regexp_extract(s, p, 1), F.lit("")) for p in HEADINGS))
    return F.when((s != "") & (F.char_length(s) <= 100), strip(found))


def section_type(text: Column) -> Column:
    first = strip(F.get(F.split(strip(text), "\n", 2), F.lit(0)))
    return F.coalesce(*(F.when(first.rlike(f"(?i)^({p})"), F.lit(name)) for name, p in SECTIONS.items()))


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_list(text: Column) -> Column:
    """Any line is a list item."""
    return text.rlike("(?md)" + LIST_ITEM)


def is_table(text: Column) -> Column:
    return text.rlike("(?d)" + TABLE_ROW) | text.rlike(TABLE_RULE)


def is_code(text: Column) -> Column:
    return text.rlike(CODE)


def words(text: Column) -> Column:
    """Lower-case words of three or more ASCII letters that aren't stopwords, in order."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<!{W})[a-z]{{3,}}+(?!{W})"), F.lit(0))
    return F.filter(runs, lambda w: ~w.isin(STOPWORDS))


def keywords(word_list: Column, most: int = 15) -> Column:
    """The commonest words, ties by first appearance.  ``word_list`` should be a column, not an expression: it is read often."""
    in_order = F.array_sort(word_list)
    return F.transform(F.array(in_order), lambda s: _ranked(s, word_list, most))[0]


def _ranked(s: Column, word_list: Column, most: int) -> Column:
    """Of the sorted words ``s``: runs of equal words, the longest first."""
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    counted = F.transform(F.array(starts), lambda at: F.zip_with(at, F.slice(F.concat(at, F.array(F.size(s))), F.lit(2), F.size(at)), lambda a, b: F.struct(
        (a - b).alias("n"), F.array_position(word_list, F.get(s, a)).alias("i"), F.get(s, a).alias("w"))))[0]
    ranked = F.transform(F.slice(F.sort_array(counted), 1, most), lambda x: x["w"])
    return F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(ranked)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bigrams(word_list: Column) -> Column:
    pairs = F.zip_with(F.slice(word_list, 1, F.greatest(F.size(word_list) - 1, F.lit(0))), F.slice(word_list, 2, F.greatest(F.size(word_list) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.array_distinct(pairs)


def entities(text: Column) -> Column:
    """Capitalised words."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{W}+"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda w: w.rlike("^[A-Z][a-z]+$")))


def weighted_similarity(a: Column, b: Column, words_a: Column, words_b: Column) -> Column:
    """Half word overlap, three tenths bigram overlap, a fifth shared capitalised words; 0 if either text is empty.

    ``words_a`` and ``words_b`` are columns with the ``words`` of both texts.
    """
    mixed = 0.5 * jaccard(F.array_distinct(words_a), F.array_distinct(words_b)) + 0.3 * jaccard(bigrams(words_a), bigrams(words_b)) + 0.2 * jaccard(entities(a), entities(b))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0)).otherwise(mixed)


def sentences(text: Column) -> Column:
    """Sentences of blank-separated words: one ends at ``.!?`` before a capitalised word, abbreviations excepted.

    One pass of a pattern over the row, no exploding into words.
    """
    flat = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"\s+", " ")
    marked = F.regexp_replace(flat, SENTENCE_END, "$1\n")
    return F.filter(F.split(marked, "\n"), lambda s: s != "")


def simple_questions(text: Column, most: int = 3) -> Column:
    """A question about the first five words of each of the first sentences; sentences of one word give none."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), strip), lambda s: s != "")
    first = F.transform(F.slice(parts, 1, most), lambda s: F.slice(F.split(s, r"\s+"), 1, 5))
    templates = F.array(*map(F.lit, QUESTIONS))
    asked = F.transform(first, lambda ws, i: F.when(F.size(ws) >= 2, F.replace(F.get(templates, i % len(QUESTIONS)), F.lit("{}"), F.array_join(ws, " "))))
    return F.filter(asked, lambda q: q.isNotNull())


def chunk_id(document: Column, index: Column, content: Column) -> Column:
    """Document, number and twelve hex digits over both and the first hundred characters."""
    doc, i = document.cast("string"), index.cast("string")
    return F.concat(doc, F.lit("_chunk_"), i, F.lit("_"), F.left(F.md5(F.concat_ws("_", doc, i, F.left(content, F.lit(100))).cast("binary")), F.lit(12)))


def parent_index(child: Column, n_children: Column, n_parents: Column) -> Column:
    return F.least(F.floor(child * n_parents / F.greatest(n_children, F.lit(1))), n_parents - 1).cast("long")


def markdown_table(rows: Column) -> Column:
    """``array<array<string>>`` as a Markdown table, the first row on top; null cells are empty, short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    full = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(full(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    drawn = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, 2, F.greatest(F.size(drawn) - 1, F.lit(0)))), "\n")

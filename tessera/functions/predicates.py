"""Line predicates as regular expressions, in Java's dialect for Spark and in RE2's for the SQL that checks them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define each line feature.
PATTERNS = {
    "enum": r"^\s*\(?\d+\s*[.)\]]\s",
    "bullet": r"^\s*[-*•▸‣]+\s",
    "hash": r"^\s*#{1,6}\s",
    "upper_word": r"^\s*([A-ZÀ-Ý][a-zA-Zà-ÿ]+)(\s|[:.])",
    "dash": r"^\s*[-–—]{1,2}\s",
    "title": r"^\s*[A-ZÀ-Ý][a-zà-ÿ]+",
    "colon": r":\s*$",
    "ends_q": r"[?¿]\s*$|\?\*{1,2}\s*$",
    "ends_sent": r"[.!?;:]\s*$",
    "field": r"^[A-ZÀ-Ý][\wÀ-ÿ ]{2,40}:\s",
    "bold_field": r"^[-*•]?\s*\*{1,2}[\wÀ-ÿ ]{1,40}:\*{0,2}",
    "qword": r"^(qual|quais|quem|quando|onde|como|por que|por quê|porque|quanto|quantos|quantas|o que|que|existe|existem|tem|há|pode|posso|poderia|deve|devo|é possível|para que|será que|você sabe|preciso|precisa|what|which|who|whom|whose|when|where|how|why|can|could|does|do|did|is|are|was|were|will|would|should|may|might|am|have|has)\b",
    "date": r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}",
    "month": r"\b(jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez|feb|apr|may|aug|sep|oct|dec|janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro|january|february|march|april|june|july|august|september|october|november|december)[a-zç]*\.?\s+\d{1,2}",
    "year": r"\b(19|20)\d{2}\b",
    "year_context": r"(de|em|dia|data|sessão|aula|palestra|evento|workshop|session|day|date)\b",
    "time": r"\b\d{1,2}\s?[:h]\s?\d{2}\b|\b([01]?\d|2[0-3])\s?[hH]\b|\b\d{1,2}\s?(am|pm)\b",
    "fence": r"^\s*(```|~~~)",
    "hr": r"^\s*(-{3,}|\*{3,}|_{3,}|={3,})\s*$",
    "setext": r"^\s*(=|-){3,}\s*$",
    "bquote": r"^\s*>",
    "page_num": r"^\s*(p[aá]g(ina)?\.?\s*)?[-\[(]?\s*(\d{1,4}|[ivxlcdm]{1,7})\s*[-\])]?(\s*(/|de|of)\s*\d{1,4})?\s*$",
    "url": r"(https?://|www\.|\b[\w.+-]+@[\w-]+\.[\w.]{2,})",
    "speaker": r"^\s*(\[\s*\d{1,2}[:h]\d{2}(:\d{2})?\s*\]\s*|\(\d{1,2}[:h]\d{2}\)\s*|\d{1,2}[:h]\d{2}\s+)?([A-ZÀ-Ý][\wÀ-ÿ.'-]*(\s+[A-ZÀ-Ý][\wÀ-ÿ.'-]*){0,3})\s*[:>–-]\s",
    "legal": r"^\s*(art(igo)?\.?\s*\d+|§\s*\d+|par[aá]grafo\s|inciso\s|se[cç][aã]o\s|cap[ií]tulo\s|t[ií]tulo\s[IVXLC]|anexo\s|cl[aá]usula\s|section\s+\d+|article\s+\d+|chapter\s+[\dIVXLC]|§{1,2}\s*\d)",
    "roman_enum": r"^\s*\(?([ivxlcdm]{1,7}|[a-z])\s*[.)\]]\s+",
    "ref": r"^\s*[A-ZÀ-Ý][\wÀ-ÿ'-]+,\s*[A-ZÀ-Ý]\.",
    "table_sep": r"^\s*\|?[\s:|-]*-{2,}[\s:|-]*\|?\s*$",
    "two_col": r"\S(\t|\s{3,})\S",
    "kv": r"^[^\s:][^:]{0,38}:\s+\S",
    "headerish": r"^\s*(#{1,6}\s|\*{1,2}\w|\d+[.)]\s|[A-ZÀ-Ý][A-ZÀ-Ý0-9 .&\-]{3,}\s*$)",
    "table_row": r"^\s*\|.*\|\s*$|^\s*\|?[\s:|-]*-{2,}[\s:|-]*\|?\s*$",
}
#: Forms of the same patterns for Java's matcher, which backtracks and recurses: each walks a line once, however long.
ONE_WALK = {
    "setext": r"^\s*[=-]{3,}\s*$",
    "url": r"(https?://|www\.|\w[.+-]*+@[\w-]++\.[\w.]{2,})",
    "table_sep": r"^(?=[\s:|-]*+$).*--",
    "table_row": r"^\s*\|.*\|\s*$|^(?=[\s:|-]*+$).*--",
    "headerish": r"^\s*(#{1,6}\s|\*{1,2}\w|\d+[.)]\s|[A-ZÀ-Ý][A-ZÀ-Ý0-9 .&\-]{3,}+\s*$)",
}
CAPS_TOKEN = r"[A-ZÀ-Ý][A-ZÀ-Ý0-9&\-.']*"
#: Those that ignore case, and those that look at the stripped line.
ANY_CASE = {"qword", "month", "year_context", "time", "page_num", "url", "legal", "roman_enum"}
STRIPPED = {"page_num", "colon", "ends_q", "ends_sent", "qword", "date", "month", "year", "year_context", "time", "url", "legal", "ref", "table_sep", "two_col", "kv"}
#: A further condition, in SQL that both engines read: seg is the line, st the stripped one.
AND = {"field": "length(st) <= 70", "bold_field": "instr(substring(st, 1, 44), ':') > 0", "page_num": "length(st) <= 24", "speaker": "length(st) > 4"}


@dataclass(frozen=True)
class Predicate:
    name: str

    @property
    def column(self) -> str:
        return "st" if self.name in STRIPPED else "seg"

    def spark(self) -> Column:
        """Unicode classes, LF alone as a line end, Unicode case folding."""
        pattern = ONE_WALK.get(self.name, PATTERNS[self.name])
        test = F.col(self.column).rlike(("(?dUiu)" if self.name in ANY_CASE else "(?dU)") + pattern)
        return F.expr(AND[self.name]) & test if self.name in AND else test

    def sql(self) -> str:
        pattern = PATTERNS[self.name]
        if self.name != "url":  # RE2's word boundary is ASCII; these stand at the ends of an alternative, before a digit or a group
            pattern = re.sub(r"\\b(?=\\d|\()", lambda _: r"(?:^|[^\p{L}\p{N}_])", pattern)
            pattern = re.sub(r"\\b(?=$|\|)", lambda _: r"(?:[^\p{L}\p{N}_]|$)", pattern)
        pattern = pattern.replace(r"\w", r"\p{L}\p{N}_").replace("'", "''")
        # Outside of brackets the class stands alone.
        pattern = pattern.replace(r"\*{1,2}\p{L}\p{N}_|", r"\*{1,2}[\p{L}\p{N}_]|")
        test = f"regexp_matches({self.column}, '{pattern}'{', ' + chr(39) + 'i' + chr(39) if self.name in ANY_CASE else ''})"
        return f"({test} AND {AND[self.name]})" if self.name in AND else test


ALL = {name: Predicate(name) for name in PATTERNS}


def fires(name: str) -> Column:
    return ALL[name].spark()

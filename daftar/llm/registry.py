"""Queries and SQL of this subpackage, by name."""

from .decontaminate import op8_decontaminate
from .fill_middle import op13_fill_middle
from .html_text import op5_html_text
from .language_id import op11_language_id
from .lexical_search import op12_lexical_search
from .ngram_join import op1_ngram_join
from .oracle import ORACLE_SQL
from .pii import op9_pii
from .quality_classifier import op3_quality_classifier
from .quality_rules import op2_quality_rules
from .sentencepiece_bpe import op4_sentencepiece
from .substring_dedup import op6_substring_dedup
from .toxicity import op7_toxicity
from .warc import op10_warc

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_text": op5_html_text,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
    "op11_language_id": op11_language_id,
    "op12_lexical_search": op12_lexical_search,
    "op13_fill_middle": op13_fill_middle,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

from arbitra.llm.chat import OP9_SQL, op9_chat_format
from arbitra.llm.counts import op5_token_counts
from arbitra.llm.crosstoken import op12_token_align
from arbitra.llm.divergence import OP13_SQL, op13_source_divergence
from arbitra.llm.htmltext import op11_html_text
from arbitra.llm.jaccard import op8_ngram_jaccard
from arbitra.llm.langid import op7_language_id
from arbitra.llm.mixing import OP1_SQL, op1_poisson_mix
from arbitra.llm.packing import op4_harmonic_pack
from arbitra.llm.quality import op10_mcd_outliers
from arbitra.llm.simhash import op6_simhash
from arbitra.llm.warc import op3_warc_normalise
from arbitra.llm.weak import op2_weak_quality

QUERIES = {
    f.__name__: f
    for f in (
        op1_poisson_mix, op2_weak_quality, op3_warc_normalise, op4_harmonic_pack, op5_token_counts, op6_simhash, op7_language_id,
        op8_ngram_jaccard, op9_chat_format, op10_mcd_outliers,
        op11_html_text, op12_token_align, op13_source_divergence,
    )
}
ORACLE = {"op1_poisson_mix": OP1_SQL, "op9_chat_format": OP9_SQL, "op13_source_divergence": OP13_SQL}

"""The corpus operators' queries and, where SQL can say the same, their SQL."""

from rillflow.llm import conversations, html_text, linededup, mixing, neardup, packing, quality, resampling, simhash, toxicity, url_filter, vptree, warc

QUERIES = {
    "op1_linededup": linededup.op1_linededup,
    "op2_packing": packing.op2_packing,
    "op3_neighbours": vptree.op3_neighbours,
    "op4_fingerprints": simhash.op4_fingerprints,
    "op5_html": html_text.op5_html,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_neardup": neardup.op10_neardup,
    "op11_resampling": resampling.op11_resampling,
    "op12_urls": url_filter.op12_urls,
    "op13_conversations": conversations.op13_conversations,
}

ORACLE_SQL = {
    "op6_mixing": mixing.SQL,
    "op7_warc": warc.SQL,
    "op11_resampling": resampling.SQL,
    "op12_urls": url_filter.SQL,
    "op13_conversations": conversations.SQL,
}

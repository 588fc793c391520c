"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from gleaner.llm import centroids, collocations, exact, ga2m, langid, lexicon, maintext, minmax, packing, rules, suffix, tokenfile, warc

QUERIES = {f.__name__: f for f in (
    maintext.op1_main_text, ga2m.op2_quality_gam, warc.op3_warc_normaliser, suffix.op4_suffix_dedup,
    exact.op5_exact_dedup_stream, lexicon.op6_bpe_lexicon, langid.op7_language_id, minmax.op8_minmax_near_dedup,
    packing.op9_pack_grouping_ga, rules.op10_quality_rules, collocations.op11_phrase_stripes, tokenfile.op12_token_blocks, centroids.op13_centroid_tables)}

#: The others are tested against brute force or a public library, a round trip or held-out labels.
SQL = {"op3_warc_normaliser": warc.SQL, "op5_exact_dedup_stream": exact.SQL, "op10_quality_rules": rules.SQL,
       "op11_phrase_stripes": collocations.SQL, "op13_centroid_tables": centroids.SQL}

"""The numbered queries over the given tables, with their check statements."""

from __future__ import annotations

from skyledger.llm import ann, decontam, hardneg, langid, linededup, mixing, sharding, simhash, substring, tokencount, tokenpack, turntrie, urlfilter
from skyledger.llm.common import table

QUERIES = {
    "op1_substring_dedup": lambda spark, sf_dir: substring.digest(table(spark, sf_dir, "documents")),
    "op2_token_blocks": lambda spark, sf_dir: tokenpack.round_trip(table(spark, sf_dir, "documents")),
    "op3_line_dedup": lambda spark, sf_dir: linededup.digest(table(spark, sf_dir, "documents")),
    "op4_language_id": lambda spark, sf_dir: langid.predict(table(spark, sf_dir, "documents")),
    "op5_sharding": lambda spark, sf_dir: sharding.shard_rows(table(spark, sf_dir, "documents")),
    "op6_decontamination": lambda spark, sf_dir: decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_token_counts": lambda spark, sf_dir: tokencount.count_tokens(table(spark, sf_dir, "documents")),
    "op8_nearest": lambda spark, sf_dir: ann.nearest(table(spark, sf_dir, "embeddings")),
    "op9_mixing": lambda spark, sf_dir: mixing.mix(table(spark, sf_dir, "documents")),
    "op10_simhash": lambda spark, sf_dir: simhash.near_duplicates(table(spark, sf_dir, "documents")),
    "op11_prefix_trie": lambda spark, sf_dir: turntrie.digest(table(spark, sf_dir, "conversations")),
    "op12_hard_negatives": lambda spark, sf_dir: hardneg.mine(table(spark, sf_dir, "embeddings"), hardneg.shifted_label()),
    "op13_url_filter": lambda spark, sf_dir: urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.label_outcomes(table(spark, sf_dir, "labels")), urlfilter.rule_table(spark)),
}

ORACLES = {
    "op1_substring_dedup": substring.SQL,
    "op3_line_dedup": linededup.SQL,
    "op6_decontamination": decontam.SQL,
    "op9_mixing": mixing.SQL,
    "op11_prefix_trie": turntrie.SQL,
    "op12_hard_negatives": hardneg.SQL,
    "op13_url_filter": urlfilter.SQL,
}

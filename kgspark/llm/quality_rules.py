"""Rules exported by ``quality_fit``: (kind, [(statistic, comparison, threshold), ...]) in order."""

RULES: list = [
    ('junk', [('distinct_words', '<=', 0.54902), ('n_chars', '<=', 815.1215), ('n_lines', '<=', 1.0)]),
    ('junk', [('common_share', '<=', 0.0), ('item_chars', '<=', 0.106919), ('cell_share', '<=', 0.0), ('n_chars', '>=', 119.29)]),
    ('junk', [('distinct_lines', '<=', 0.708333)]),
    ('junk', [('distinct_words', '<=', 0.708333), ('title_share', '>=', 0.640756)]),
    ('junk', [('mean_word_len', '>=', 13.898)]),
    ('junk', [('symbol_ratio', '>=', 0.106181), ('cell_share', '<=', 0.0), ('distinct_words', '<=', 0.74359)]),
    ('table', [('cell_share', '>=', 0.75), ('n_lines', '>=', 4.07)]),
    ('list', [('short_open_share', '>=', 0.8125), ('words_per_line', '<=', 5.875079)]),
    ('list', [('marker_share', '>=', 1.0)]),
]

"""Small made-up tables for measures that no table of the driver has an input for."""

from __future__ import annotations

SOURCES = [("crawl", 900_000, 360_000, "web crawl"), ("wiki", 0, 72_000, "encyclopedia"), ("test set", 36_000, None, "EVALUATION ONLY"), ("lost", None, None, "not served")]
REPLIES = [
    (1, 'Here you are: [{"enstriksyon": " a b ", "repons": "c"}, {"enstriksyon": "d", "repons": "e f"}] done'),
    (2, "no array at all"),
    (3, '[{"enstriksyon": "x", "repons": ""}, "text", {"enstriksyon": "y", "repons": "z"}]'),
    (4, '[{"enstriksyon": "cut off'),
    (5, '{"enstriksyon": "q", "repons": "r"}'),
    (6, "[]"),
]
SCORED = [(m, d, p, round((p % 37) / 10 + d + k, 4), (p * 7 + d) % 3 == 0) for k, m in enumerate(("new", "old")) for d in (1, 2) for p in range(0, 511, 5)]
SCORED_TEXTS = [("new", 2.5, 100, 300), ("new", 3.0, 31, 90), ("new", 1.25, 400, 1500), ("old", 6.0, 200, 500), ("old", 25.0, 64, 100)]
MADE = [(1, "a b c d", "a b x d"), (2, "a b", "a b c"), (3, "x y z", "a b c"), (4, "a b c d e", "a b"), (5, "a", "a")]
HISTORY = [("one", s, x) for s, x in enumerate((3.0, 2.0, 1.99995, 1.5, 1.6, 1.55, 1.49995, 1.2))] + [("two", s, x) for s, x in enumerate((2.0, 1.9, 1.8, 1.7))]
BLOCK_LOSSES = [(part, k, round(2.0 + k % 7 / 4 + n, 4)) for n, part in enumerate(("train", "val")) for k in range(23)]
WINDOWS = [(m, d, s, t, round(4.0 + d / 8 + s / 200 + n, 4)) for n, m in enumerate(("new", "old")) for d, t in enumerate((40, 64, 500, 663, 664, 2000)) for s in (0, 600) if (m, s) != ("old", 600)]
ENDINGS = [("new", 0, 0, 5, 60, 120), ("new", 7, 0, 5, 125, 120), ("new", 7, 0, 5, 90, 120), ("old", 9, None, 4, 124, 120), ("old", 0, 0, 4, 124, 120)]
VOCABULARIES = [("new", 0, 32_768), ("old", 50_256, 33_977), ("unset", None, 100)]
CHECKS = [("one", s, 0, 1000, 49_152, 40.0 * (s + 1)) for s in (99, 199, 999)] + [("two", 149, 100, 400, 8_192, 33.5)]
RUNS = [("small", 1_000, 1_024, 8, 6, 4.0, 111_000_000), ("large", 4_000_000, 1_024, 8, 6, 0.5, 1_000_000), ("tiny", 10, 64, 8, 6, 2.5, 1_000)]
TOKEN_COUNTS = [("mine", 1296, 1000), ("mine", 648, 500), ("theirs", 1406, 1000), ("theirs", 703, 500)]
CONFIGS = [("one", "hat_Latn"), ("one", "fra_Latn"), ("one", "ht"), ("one", "default"), ("two", "Creole"), ("two", "htA"), ("two", "HTB"), ("two", "acre"), ("two", "zht"), ("three", "en")]
PAGES = [("training_summary", '{"parameters": 111000000, "unique_train_tokens": 466421760, "epochs": 4.0, "best_eval_perplexity": 21.5}'), ("comparison", '{"new": {"bits_per_character": 1.129}, "old": {"bits_per_character": 4.526}}')]

"""The odd texts again, for tests that look at them outside Spark."""

ODD_TEXTS = [
    None, "", " ", "\n\t ", "a", "Hello, world.", "A b c", "a  b   c", "...", "é É ü 中文 😀", "x" * 60_000,
    "word " * 30_000, "<|endoftext|> it's, I'LL don't.", "▁ a ▁b", "tab\tand blank", "1 2 3 4.5,6", "\x1f\x1e\x1d\x1c",
]

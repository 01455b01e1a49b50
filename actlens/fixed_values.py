"""Formats that stored datasets depend on.

They are part of the data contract (tables written earlier hold them), so they
are given here as plain text, in one place.
"""

# Tags and placeholders found inside stored text.
EXPLANATION_OPEN = "<explanation>"
EXPLANATION_CLOSE = "</explanation>"
INJECT_PLACEHOLDER = "<INJECT>"

# Completer output: the tagged body that is kept.
RESPONSE_PATTERN = r"<analysis>\s*(.*?)\s*</analysis>"

# List markers stripped from the start of a feature line, and a leading bold run.
LIST_MARKER = r"^\s*(?:[-*•+–—]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+"
LEADING_BOLD = r"^\*\*(.+?)\*\*\s*"

# Prompt templates written into training tables.
ACTOR_TEMPLATE = """You are a meticulous AI researcher conducting an important investigation into activation vectors from a language model. Your overall task is to describe the semantic content of that activation vector.

We will pass the vector enclosed in <concept> tags into your context. You must then produce an explanation for the vector, enclosed within <explanation> tags. The explanation consists of 2-3 text snippets describing that vector.

Here is the vector:

<concept>{injection_char}</concept>

Please provide an explanation."""
CRITIC_TEMPLATE = "Summary of the following text: <text>{explanation}</text> <summary>"

# Sampling, filtering and scoring defaults.
MIN_POSITION = 50
MIN_FEATURES = 2
MIN_MATCH_RATE = 0.95
ROW_GROUP_ROWS = 65536
NORM_FLOOR = 1e-12
MSE_FLOOR = 1e-8
FAILED_REWARD = -2.0
MAX_CRITIC_TOKENS = 512

# Source labels of a document id, in order of test.
SOURCE_LABELS = (("WildChat", "WildChat"), ("Ultra-FineWeb", "UFW"))
OTHER_SOURCE = "other"

# Substrings that must not leave the house in published text.
LEAK_PATTERNS = ("gs://", "s3://", "/mnt/", "/tmp/", "iter_", "rollout_id")

# Model presets: hub name, layers, vector width.
MODEL_PRESETS = {
    "qwen7b": ("Qwen/Qwen2.5-7B-Instruct", 28, 3584),
    "gemma12b": ("google/gemma-3-12b-it", 48, 3840),
    "gemma27b": ("google/gemma-3-27b-it", 62, 5376),
    "llama70b": ("meta-llama/Llama-3.3-70B-Instruct", 80, 8192),
}

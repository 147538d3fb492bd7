"""Sizes of the registered queries.

Shared preparations use the operators' own production values, and so cover all rows. The
second group holds the sizes of queries whose subject is a limit; they take effect on tables
of a few thousand rows and are used in those queries alone.
"""

from gristmill.operators import chats, filters, ngram, splits

SHORTEST = filters.MIN_CHARS
LONGEST = filters.MAX_CHARS
TARGET_TOKENS = filters.TARGET_TOKENS
MIN_REPLY = chats.MIN_REPLY_CHARS
MOST_SAMPLES = chats.MAX_SAMPLES
TOP_K = 50
RECENT = ngram.RECENT
SEED = splits.SEED

# Limits that bite: filter_length and filter_counts; take_until_budget and the first of two
# runs (resume_ingest, missing_shards); cap_samples; reject_short_reply and format_counts.
SHARP_LONGEST = 10_000
BUDGET_TOKENS = 100_000
CAP_SAMPLES = 50
SHARP_REPLY = 150
TOKEN_CAP = 150_000

# Sizes of output units, which no row is lost to. The vocabulary is small enough that pieces
# outside of it, which become bytes, occur at any table size.
VOCAB_SIZE = 2_000
RAW_SHARD_ROWS = 100
VAL_SHARD_SHARE = 0.2
TOKEN_SHARD = 20_000
VAL_SAMPLE_SHARE = 0.1
MIN_VAL_SAMPLES = 10
BATCH = 4
BLOCK = 64
CURSOR = (3, 1_000)
EPOCHS = 2
WINDOWS = 200

TOKENS_PER_STEP = 32 * 17 * 2048
PARAMETERS = 353_600_000
LOG_EVERY = 10
LOG_FILES = 12
LOG_FILES_PER_BATCH = 4
LAST_STEPS = 20
STEPS = 100
SAVE_EVERY = 5
KEEP_LAST = 3
PHASES = ("click", "view", "purchase", "signup", "error")
TEMPERATURE = 0.8
PENALTY = 1.15

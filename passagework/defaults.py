"""Default parameters and enumerations shared by all operators."""

# They must equal the published service defaults so that results agree.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
SEMANTIC_PERCENTILE = 90.0
SEMANTIC_MAX_CHARS = 2048
DENSE_TOP_K = 20
SPARSE_TOP_K = 20
RRF_K = 60
FINAL_TOP_K = 5
MAX_ROUNDS = 2
MAX_CONTEXT_CHUNKS = 8
INJECTION_THRESHOLD = 0.5
PERMUTATIONS = 128
SHINGLE_WORDS = 5
SIGNATURE_SEED = 42
NEAR_THRESHOLD = 0.9
CACHE_TTL_SECONDS = 86_400
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
MIN_QUERY_CHARS = 1
MAX_QUERY_CHARS = 4000
QUOTE_CHARS = 200
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

FORMATS = ("pdf", "docx", "markdown", "html", "text")
STATUSES = ("pending", "processing", "indexed", "failed", "superseded")
CATEGORIES = ("factual", "analytical", "summary", "out_of_scope")
ORIGINS = ("dense", "sparse", "fused", "reranked")
PII_TYPES = ("email", "credit_card", "ssn", "iban", "ip_address", "phone")

# Digits kept of a score before it is ranked: sums of doubles depend on the
# order of addition, so raw scores would make ties flip between runs.
RANK_DIGITS = 9
HASH_DIM = 64

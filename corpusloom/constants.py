"""Names and numbers that the corpus formats fix."""

ROW = "_row_idx"
ID, TRANSCRIPT = "ID", "transcript"
TOKENIZED, NORMALIZED, UROMAN = "tokenized", "normalized", "uroman"
SPEECH_TOKENS, STARTS, ENDS, ALIGNMENT = "speech_tokens", "aligned_token_start_time", "aligned_token_end_time", "alignment"
TEXT_KEY = "text"

SEED = 42831
SAMPLE_RATE = 16_000
DOWNSAMPLING = 320
FRAMES_PER_SECOND = SAMPLE_RATE // DOWNSAMPLING
FRAME_MS = 20
EMISSION_WINDOW_S, EMISSION_CONTEXT_S = 30, 3
MAX_AUDIO_S = 100

# fixed values: private use code points of speech units, and the two modality marks
PUA_FIRST, PUA_LAST = 983_040, 1_048_573
MAX_UNIT = PUA_LAST - PUA_FIRST
SPEECH_MARK, TEXT_MARK = chr(0xE000), chr(0xE001)

BLANK, STAR = "<blank>", "<star>"
VOCABULARY_MULTIPLE = 128
SPAN_TOKENS, SPAN_SHARE = 39, 0.1

# fixed values: the tags of one of the corpora, and the sizes of the published splits
PUNCTUATION_TAGS = {"<COMMA>": ",", "<PERIOD>": ".", "<QUESTIONMARK>": "?", "<EXCLAMATIONPOINT>": "!"}
GARBAGE_TAGS = ("<SIL>", "<MUSIC>", "<NOISE>", "<OTHER>")
MLS_SPLIT_SIZES = {"train": 10_808_037, "validation": 3_807, "test": 3_769}
CODEC_LAYERS = 8

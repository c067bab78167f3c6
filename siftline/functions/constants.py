"""Word lists, weights and limits that results depend on."""

# fixed values: extensions whose text is indexed
CONTENT_EXTENSIONS = "pdf docx xlsx txt md csv json yml yaml xml rs ts js py go rb java c cpp h html css toml ini cfg conf sh zsh log sql tsx jsx png jpg jpeg heic".split()
# fixed values: extensions read by OCR
OCR_EXTENSIONS = "png jpg jpeg heic".split()
# fixed values: extensions that get an embedding
EMBED_EXTENSIONS = "md txt pdf docx xlsx rs ts tsx js jsx py go rb java c cpp h swift csv html htm".split()
# fixed values: extensions taken as a type filter at the end of a query
QUERY_EXTENSIONS = (
    "pdf doc docx xls xlsx ppt pptx txt md csv json yml yaml xml png jpg jpeg gif svg webp ico mp3 mp4 mov avi wav zip tar gz rar 7z "
    "rs ts js py go rb java c cpp h html css scss less sh zsh bash toml ini cfg conf env log sql"
).split()
# fixed values: extensions that the recent view leaves out
RECENT_EXCLUDED = (
    "rs ts tsx js jsx py go rb java c cpp h hpp cs swift kt scala clj ex exs hs ml fs json jsonl toml yaml yml xml lock sum sh zsh bash fish ps1 "
    "css scss less sass gitignore dockerignore editorconfig eslintrc prettierrc o a dylib so dll wasm class pyc pyo d map"
).split()
# fixed values: LIKE patterns that the recent view and pending work leave out
RECENT_EXCLUDED_PATHS = [
    "%/node_modules/%", "%/.git/%", "%/target/%", "%/.build/%", "%/__pycache__/%", "%/.venv/%", "%/dist/%", "%/.next/%", "%/.cache/%", "%/.local/share/Trash/%",
]
# fixed values: directories and artefacts that a scan leaves out (several components, *suffix, or one component)
DEFAULT_EXCLUDES = [
    "node_modules", ".git", ".DS_Store", "Library/Caches", "Library/Application Support", ".Trash", ".cargo", ".rustup", "target", ".npm", ".bun", ".venv",
    ".mypy_cache", "__pycache__", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".eggs", "*.egg-info", ".cache", ".gradle", ".idea", ".vscode", ".next",
    ".nuxt", "dist", "build", ".turbo", ".parcel-cache", ".angular", "Pods", ".dart_tool", ".pub-cache",
]
# fixed values: preset excludes and roots
HOME_EXCLUDES = [".cache", ".local/share/Trash"]
OS_EXCLUDES = ["/proc", "/sys", "/dev", "/run", "/snap", "/boot"]
DEFAULT_ROOTS = ["~/Documents", "~/Desktop", "~/Downloads", "~/Projects", "~/Pictures"]
HOT_FOLDERS = ["~/Downloads", "~/Desktop", "~/Documents"]
# fixed values: extensions without a snippet from the file itself
BINARY_EXTENSIONS = "pdf docx xlsx png jpg jpeg heic tiff webp gif bmp ico svg".split()
# fixed values: score bases
PREFIX, CONTAINS, TYPO, CONTENT, SEMANTIC, FUZZY, BOTH = 10000.0, 5000.0, 3000.0, 2000.0, 1500.0, 1000.0, 500.0
# fixed values: bonus by extension, others 50
TYPE_BONUS = {
    200.0: "pdf doc docx xls xlsx ppt pptx".split(),
    150.0: "txt md csv".split(),
    120.0: "png jpg jpeg gif svg webp".split(),
    100.0: "mp3 mp4 mov avi wav flac".split(),
    80.0: "zip tar gz rar 7z".split(),
    20.0: "json yml yaml toml xml ini cfg conf".split(),
    10.0: "rs ts tsx js jsx py go rb java c cpp h html css scss sh".split(),
}
# fixed values: lower bounds of the tier buckets 6 to 2, others 1
BUCKETS = [(9000.0, 6), (4000.0, 5), (2500.0, 4), (1800.0, 3), (1200.0, 2)]
# fixed values: weight of an interaction by age in days, older ones 0
DECAY = [(7, 1.0), (30, 0.5), (90, 0.2), (365, 0.1)]
# fixed values: marks of raw PDF structure
PDF_MARKERS = [" obj", "endobj", "xref", "trailer", "startxref", "/Type", "/Page", "/Font", "/Length", "stream\n", "endstream"]
# fixed values: query syntax characters that are escaped
SYNTAX = '+-!(){}[]^"~*?:\\/'
# fixed values: limits
TEXT_BYTES, INDEX_BYTES, DOC_CHARS, SNIPPET_BYTES, FILE_BYTES = 102_400, 1_000_000, 200_000, 204_800, 104_857_600
COSINE_FLOOR, RECENT_VECTORS, OCR_CONFIDENCE = 0.15, 2000, 0.3
K1, B = 1.2, 0.75
ACTIONS = ["open", "finder", "copy", "preview", "trash"]
SCHEMA_VERSION = "3"

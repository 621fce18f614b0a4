"""Results depend on them, so they are stated here once and nowhere else."""

from __future__ import annotations

# Evidence kinds in order of precedence; the place is the rank.
EVIDENCE_KINDS = (
    "exif-original", "derived-original", "pixel-original", "filename-timestamp", "container-created", "filename-epoch", "exif-modify",
    "sidecar", "dirname", "filename-year", "family", "dir-cohort", "editor-save", "fs-mtime",
)
RANK = {kind: rank for rank, kind in enumerate(EVIDENCE_KINDS)}
# Default confidence of a kind.
CONFIDENCE = {kind: "high" if rank < 6 else "medium" if rank < 9 else "low" for kind, rank in RANK.items()}
# Kinds whose wall clock can be that of a reset camera; kinds that give a year only; kinds that are assumptions.
RESET_CLOCK_KINDS = ("exif-original", "derived-original", "pixel-original", "exif-modify", "sidecar", "filename-timestamp")
PARTIAL_KINDS = ("dirname", "filename-year", "family", "dir-cohort")
ASSUMED_KINDS = ("family", "dir-cohort")
# Kinds that count when the floor year is found.
FLOOR_KINDS = ("exif-original", "derived-original", "pixel-original", "filename-timestamp", "sidecar")
MEDIA_KINDS = ("photo", "video", "audio")

MIN_YEAR, FUTURE_YEARS, EPOCH_MIN_YEAR = 1990, 1, 2008
FLOOR_SHARE, FLOOR_COUNT = 0.001, 3
SPIKE_COUNT, SPIKE_SHARE = 3, 0.1
COHORT_COUNT, COHORT_SHARE = 3, 0.8
FAMILY_NEIGHBOURS = 3
BOUNDARY_HOURS = 12
PIXEL_LEAST, PIXEL_MOST, PIXEL_LEVELS = 3, 500, 2

# Names of directories in the planned layout.
WINTER_START, SPRING, SUMMER, AUTUMN, WINTER_END = "Зима начало года", "Весна", "Лето", "Осень", "Зима конец года"
SEASON_WORDS = ("зима", "весна", "лето", "осень")
SEASON_OF_WORD = {"весна": SPRING, "лето": SUMMER, "осень": AUTUMN}
GLOBAL_OTHER, JUNK_DIR, DUPES_DIR, YEAR_OTHER, REVIEW_DIR, INBOX_DIR = "ПРОЧЕЕ", "_мусор", "_дубликаты", "прочее", "НА_РАЗБОР", "НОВОЕ"
KIND_SUBDIR = {"video": "видео", "audio": "аудио"}

# Directory names that devices and programs give, in lower case.
TECHNICAL_DIRS = (
    "dcim", "camera", "camera roll", "screenshots", "screenshot", "downloads", "download",
    "pictures", "my pictures", "images", "photos", "video", "videos", "my videos", "movies",
    "audio", "music", "sounds", "bluetooth", "sent", "received",
    "whatsapp images", "whatsapp video", "whatsapp audio", "whatsapp documents",
    "telegram", "telegram images", "telegram video", "viber images", "viber",
    "видео", "аудио", "фото", "музыка", "картинки", "изображения", "загрузки",
)
LAYOUT_DIRS = tuple(x.lower() for x in (WINTER_START, SPRING, SUMMER, AUTUMN, WINTER_END, YEAR_OTHER, GLOBAL_OTHER, JUNK_DIR, DUPES_DIR, REVIEW_DIR, INBOX_DIR))
# Names that say nothing, and localised device names: directories that need a decision.
PLACEHOLDER_DIRS = (
    "разное", "разности", "всякое", "мусор", "хлам", "ерунда", "новая папка", "папка", "без названия", "без имени", "безымянная",
    "new folder", "new folder (2)", "untitled", "unnamed", "folder", "misc", "other", "stuff", "temp", "tmp", "разобрать", "разобрать потом", "todo",
)
DEVICE_DIRS = (
    "скриншоты", "снимки экрана", "снимок экрана", "камера", "фотокамера", "загрузки", "закачки",
    "изображения", "картинки", "рисунки", "мои рисунки", "мои изображения", "мои документы",
    "видеозаписи", "ролики", "звукозаписи", "записи", "полученные", "отправленные", "входящие",
)

# Patterns (Java syntax; an unescaped (?u) folds Cyrillic too).
COPY_MARKER = r"(?iu)(\(\s*копия\s*\d*\s*\)|-\s*копия(\s*\(\d+\))?$|\(\s*copy\s*\d*\s*\)|-\s*copy(\s*\(\d+\))?$|\(\d+\)$|\s+копия$|\s+copy$)"
DEVICE_DUMP = r"^[0-9]{3}[A-Za-z][A-Za-z0-9_-]{0,9}$"
YEAR_TOKEN = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"
SEASON_TOKEN = r"(?iu)(?:^|[^а-яё])(зима|весна|лето|осень)(?:[^а-яё]|$)"
RUN_ID = r"run-[0-9]{8}-[0-9]{6}-[0-9a-f]+"

JUNK_NAMES, JUNK_EXTENSIONS = ("thumbs.db", ".nomedia", "desktop.ini", ".ds_store"), (".tmp", ".lnk", ".bak", ".thm")
PHOTO_BRANDS = ("heic", "heix", "heif", "hevc", "mif1", "msf1", "avif")
SIDECAR_EXTENSIONS = (".thm", ".xmp")
XMP_DATES = ("exif:DateTimeOriginal", "photoshop:DateCreated")
SNIFF_BYTES = 208
# Software tags of editors: a save by one of them is no capture date.
EDITORS = r"(?i)photoshop|picasa|snapseed|paint\.net|lightroom"

MONTHS_GENITIVE = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
BYTE_UNITS = ("Б", "КБ", "МБ", "ГБ", "ТБ")
# Why a copy was kept, in order of the criteria.
KEEPER_REASONS = (
    "у него самая надёжная дата",
    "его дата установлена, а не предположена",
    "его имя не помечено как копия",
    "он уже разложен в библиотеке, а второй только что попал в папку «НОВОЕ»",
    "он лежит ближе всех к верху дерева папок",
    "первый по порядку пути — всё остальное у них одинаково",
)
KEEPER_REASON_LINK = "; далее — "
SORT_ANSWERS = ("сортировать", "сортируй", "разобрать", "да", "sort", "yes", "+")
AS_IS_ANSWERS = ("как есть", "какесть", "оставить", "оставь", "не трогать", "нет", "asis", "as-is", "keep", "no", "-")

#: What the library itself writes at a root; no scan lists it.
RUNS_DIR, RECEIPT = ".tidemark-runs", "TIDEMARK.txt"

#: Characters from which on a Windows path needs its prefix.
LONG_PATH = 260

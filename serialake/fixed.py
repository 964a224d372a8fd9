"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# --- fixed values: line patterns of the default blacklist (regular expressions, case-insensitive) ---
BLACKLIST_PATTERNS = [
    r"^nguồn: .*",
    r"^truyện: .*",
    r"^thể loại: .*",
    r"^chương: .*",
    r"menu",
    r"hiện menu",
    r"doc truyen",
    r"danh sách",
    r"bình luận",
    r"báo lỗi chương",
    r"liên hệ",
    r"online",
    r"website hoạt động",
    r"creative commons",
    r"^[-–—=~\s]{2,}$",
    r"quảng cáo",
    r"nhớ cho 1 đánh giá",
    r"website có một số quảng cáo",
    r"để có kinh phí duy trì",
    r"click theo dõi",
    r"fanpage",
    r"tổng hợp thư viện sách hay",
    r"click vào xem",
    r"các bạn đang đọc truyện tại",
    r"metruyenfull.net",
    r"được đề xuất cho bạn",
    r"báo lỗi chương",
    r"chương lỗi",
    r"back to top",
    r"facebook",
    r"shopee",
    r"lazada",
    r"banner",
    r"phá quân vũ đế hồi sinh chuyển thế",
    r"thần đồng đoản mệnh",
    r"nam chính xuyên qua",
    r"thái tử đại chu",
    r"bạn có thể",
    r"hỗ trợ mọi thiết bị",
    r"truyện mới cập nhật",
    r"truyện hot",
    r"truyện full",
    r"(Tấu chương xong)",
    r"Click Theo Dõi -> Fanpage Để phòng website đổi tên miền khác hoặc nhận các thông báo sớm nhất từ admin nhé",
]

# --- fixed values: header prefixes dropped from the top of a stored body ---
HEADER_PREFIXES = ["nguồn:", "truyện:", "thể loại:", "chương:"]

# --- fixed values: a short line survives the blacklist only with one of these endings ---
SHORT_LINE_LENGTH = 5
SHORT_LINE_ENDINGS = [".", "?", "!", ":", '"', "'"]

# --- fixed values: phrases of challenge and block pages ---
BLOCK_PHRASES = [
    "bạn đã bị chặn",
    "checking your browser",
    "ddos protection by cloudflare",
    "verifying you are human",
    "enable javascript and cookies to continue",
    "cloudflare's security check",
]
BLOCK_TITLE_PHRASES = [
    "just a moment",
    "checking your browser",
    "ddos",
    "cloudflare",
    "attention required",
    "access denied",
    "checking connection",
]
BLOCK_MIN_LENGTH = 100
BLOCK_MAX_BODY_WORDS = 50

# --- fixed values: job types a dispatcher accepts, with the fields each one needs ---
JOB_REQUIRED_FIELDS = {
    "single_story": ["title"],
    "missing_check": [],
    "healthcheck": ["site_key"],
    "retry_chapter": ["chapter_url", "chapter_title", "story_title", "filename", "site"],
    "check_missing_chapters": [],
    "retry_failed_genres": ["site_key"],
    "full_site": ["site_key"],
    "all_sites": [],
}

# --- fixed values: letters without a canonical decomposition ---
STROKE_LETTERS = {"đ": "d", "Đ": "D"}
SPECIAL_LETTERS = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H",
    "ı": "i", "ð": "d", "Ð": "D", "ŧ": "t", "Ŧ": "T", "ŋ": "n",
}
DIGRAPH_LETTERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "…": "...",
}
PLAIN_PUNCTUATION = {
    " ": " ", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "«": "<<", "»": ">>",
}


@lru_cache(maxsize=1)
def decomposable_letters() -> dict[str, str]:
    """Every Latin letter whose canonical decomposition is one ASCII letter plus marks (a rule, not a list)."""
    table = {}
    for start, stop in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for code in range(start, stop):
            char = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
            if base != char and len(base) == 1 and base.isascii():
                table[char] = base
    return table

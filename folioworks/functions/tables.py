"""Lookup tables. Every one is a default that a caller can replace."""

# Extensions and MIME types.
MIME = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "xht": "application/xhtml+xml", "css": "text/css",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp",
    "svg": "image/svg+xml", "webp": "image/webp", "ico": "image/x-icon", "wav": "audio/wav", "mp3": "audio/mpeg", "mid": "audio/midi",
    "midi": "audio/midi", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf", "otf": "font/otf", "txt": "text/plain", "xml": "text/xml",
}

# Names of encodings as pages write them.
CHARSETS = {
    "gb2312": "gbk", "gb-2312": "gbk", "x-gbk": "gbk", "gbk": "gbk", "gb18030": "gb18030", "big5": "big5", "big5-hkscs": "big5",
    "sjis": "shift_jis", "shift-jis": "shift_jis", "shift_jis": "shift_jis", "cp932": "shift_jis", "windows-31j": "shift_jis",
    "euc-jp": "euc-jp", "euc-kr": "euc-kr", "cp949": "euc-kr", "utf8": "utf-8", "utf-8": "utf-8", "ascii": "windows-1252", "us-ascii": "windows-1252",
    "latin1": "windows-1252", "iso-8859-1": "windows-1252", "windows-1252": "windows-1252", "windows-1251": "windows-1251", "windows-1250": "windows-1250",
    "windows-1253": "windows-1253", "windows-1254": "windows-1254", "windows-1255": "windows-1255", "windows-1256": "windows-1256", "windows-874": "windows-874",
}

# Encodings by the low 16 bits of a locale id.
LOCALES = {
    0x0804: "gbk", 0x1004: "gbk", 0x0C04: "big5", 0x0404: "big5", 0x1404: "big5", 0x0411: "shift_jis", 0x0412: "euc-kr", 0x0419: "windows-1251",
    0x0405: "windows-1250", 0x040E: "windows-1250", 0x0408: "windows-1253", 0x041F: "windows-1254", 0x040D: "windows-1255", 0x0401: "windows-1256", 0x041E: "windows-874",
}

# First characters of each pinyin initial in collation order.
PINYIN = {
    "阿": "a", "八": "b", "嚓": "c", "咑": "d", "妸": "e", "发": "f", "旮": "g", "哈": "h", "讥": "j", "咔": "k", "垃": "l", "妈": "m",
    "拏": "n", "噢": "o", "妑": "p", "七": "q", "呥": "r", "仨": "s", "他": "t", "屲": "w", "夕": "x", "丫": "y", "帀": "z",
}

# Rules that add search keys to a label.
ALIASES = {
    "借机攻击|机会攻击": ["opportunityattack", "opportunity", "oa"], "倒地": ["prone"], "擒抱|受擒": ["grapple", "grappled"], "震慑": ["stunned", "stun"],
    "昏迷": ["unconscious"], "失能": ["incapacitated"], "束缚": ["restrained"], "隐形": ["invisible"], "魅惑": ["charmed"], "恐慌|恐惧": ["frightened"], "中毒": ["poisoned"],
}

# Entities that are decoded in one pass.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™"}

# Elements and attributes that refer to resources.
RESOURCES = [
    ("img", "src"), ("source", "src"), ("audio", "src"), ("video", "src"), ("video", "poster"), ("track", "src"), ("body", "background"), ("table", "background"),
    ("td", "background"), ("th", "background"), ("image", "href"), ("image", "xlink:href"), ("use", "href"), ("use", "xlink:href"),
]

# Elements and attributes that a page loses before it is shown.
ACTIVE_ELEMENTS = "script noscript iframe frame frameset object embed applet form input button textarea select option base template".split()
ACTIVE_ATTRIBUTES = "srcdoc ping formaction integrity crossorigin target bgcolor text link vlink alink srcset".split()

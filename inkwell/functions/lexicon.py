"""Fixed values of the editorial checks: labels of page furniture, qualifiers of numbers, cues."""

from __future__ import annotations

#: Whole lines of page furniture, by class and in order. Patterns match without case.
NOISE = {
    "save_share_print": [
        r"save it for later", r"save for later", r"save", r"share", r"print", r"copy link",
        r"保存", r"稍后阅读", r"分享", r"打印", r"复制链接",
    ],
    "subscribe_newsletter": [
        r"subscribe", r"subscribe to (?:our |the )?newsletter", r"sign up for (?:our |the )?newsletter", r"newsletter sign[ -]?up",
        r"订阅", r"订阅简报", r"注册提醒",
    ],
    "cookie_language": [
        r"en", r"english", r"accept (?:all )?cookies", r"cookie preferences", r"language",
        r"接受(?:全部)? cookie", r"cookie 偏好", r"语言",
    ],
    "progress_widget": [
        r"progress\s*:\s*(?:\d+(?:\.\d+)?%?)?", r"reading progress\s*:\s*(?:\d+(?:\.\d+)?%?)?", r"\d+\s+min(?:ute)?s? read",
        r"阅读进度\s*[::]　?\s*(?:\d+(?:\.\d+)?%?)?", r"预计阅读时间\s*[::]　?\s*\d+\s*分钟",
    ],
    "duplicate_navigation": [
        r"home", r"previous(?: article)?", r"next(?: article)?", r"back to top",
        r"首页", r"上一篇", r"下一篇", r"返回顶部",
    ],
}

#: Labels of links, and the parts of an address that agree with them.
LINK_TARGETS = [
    (r"print|打印", ["print", "printable"]),
    (r"share|分享", ["share"]),
    (r"save|save (?:it )?for later|保存|稍后阅读", ["save"]),
    (r"subscribe|订阅|订阅简报", ["subscribe", "newsletter"]),
]

#: Qualifiers of numbers by category, in order: key, symbols, English patterns, local words.
QUALIFIERS = {
    "rate": [
        ("rate:permille", ["‰"], [], []),
        ("rate:percent", ["%"], [r"percent", r"per\s+cent"], []),
    ],
    "scale": [
        ("scale:trillion", [], [r"trillion"], ["万亿"]),
        ("scale:billion", [], [r"billion"], ["十亿"]),
        ("scale:million", [], [r"million"], ["百万"]),
        ("scale:thousand", [], [r"thousand"], ["千"]),
        ("scale:ten_thousand", [], [], ["万"]),
    ],
    "currency": [
        ("currency:HKD", ["HK$"], [r"HKD", r"Hong\s+Kong\s+dollars?"], ["港元", "港币"]),
        ("currency:AUD", ["A$"], [r"AUD", r"Australian\s+dollars?"], ["澳元"]),
        ("currency:CAD", ["C$"], [r"CAD", r"Canadian\s+dollars?"], ["加元"]),
        ("currency:SGD", ["S$"], [r"SGD", r"Singapore\s+dollars?"], ["新加坡元", "新元"]),
        ("currency:USD", ["US$", "$"], [r"USD", r"(?:US\s+)?dollars?"], ["美元"]),
        ("currency:EUR", ["€"], [r"EUR", r"euros?"], ["欧元"]),
        ("currency:GBP", ["£"], [r"GBP", r"pounds?"], ["英镑"]),
        ("currency:CNY", ["¥"], [r"CNY", r"RMB", r"yuan"], ["元人民币", "人民币", "元"]),
    ],
    "unit": [
        ("unit:km", [], [r"kilomet(?:er|re)s?", r"km"], ["公里", "千米"]),
        ("unit:kg", [], [r"kilograms?", r"kg"], ["公斤"]),
        ("unit:GB", [], [r"gigabytes?", r"GB"], []),
        ("unit:MB", [], [r"megabytes?", r"MB"], []),
        ("unit:TB", [], [r"terabytes?", r"TB"], []),
        ("unit:kWh", [], [r"kilowatt[ -]?hours?", r"kWh"], ["千瓦时"]),
        ("unit:MWh", [], [r"megawatt[ -]?hours?", r"MWh"], ["兆瓦时"]),
        ("unit:GWh", [], [r"gigawatt[ -]?hours?", r"GWh"], ["吉瓦时"]),
        ("unit:Wh", [], [r"watt[ -]?hours?", r"Wh"], ["瓦时"]),
        ("unit:kW", [], [r"kilowatts?", r"kW"], ["千瓦"]),
        ("unit:MW", [], [r"megawatts?", r"MW"], ["兆瓦"]),
        ("unit:GW", [], [r"gigawatts?", r"GW"], ["吉瓦"]),
        ("unit:tonne", [], [r"metric\s+tonnes?", r"tonnes?", r"tons?"], ["公吨", "吨"]),
        ("unit:token", [], [r"tokens?"], ["令牌", "词元"]),
        ("unit:second", [], [r"seconds?", r"secs?"], ["秒"]),
        ("unit:month", [], [r"months?"], ["个月", "月"]),
        ("unit:basis_point", [], [r"basis\s+points?", r"bps"], ["个基点", "基点"]),
        ("unit:celsius", [], [], ["°C"]),
        ("unit:fahrenheit", [], [], ["°F"]),
    ],
}

#: What makes a qualifier apart from its number count; {q} stands for the qualifier.
CUES = [
    r"以\s*({q})\s*(?:为单位|计)",
    r"按\s*({q})\s*(?:计算|计)",
    r"单位\s*(?:为|是|[:：=])\s*({q})",
    r"(?:measured|expressed|calculated)\s+in\s+({q})",
    r"(?:the\s+)?unit\s*(?:is|was|[:=])\s*({q})",
    r"using\s+({q})\s+as\s+(?:the\s+)?unit",
]

#: Boundaries of English words, what may follow a local word, and words that begin a caption.
ENGLISH_BOUNDARY = (r"(?<![A-Za-z0-9_])", r"(?![-A-Za-z0-9_])")
LOCAL_FOLLOWERS = r"(?:为单位|计算|计)(?!\p{Han})"
CAPTION = r"\s*(?:表格?|图(?:表|示)?|figure|fig\.?|chart)\s*\d*\s*[:：.\-]?\s*"
UNIT_LABEL = r"(?:单位|unit)\s*[:：]\s*"

#: Fixed value: characters between a number and a cued qualifier that still belong together.
REACH = 32
#: Fixed value: the cost of leaving an item out of an alignment.
GAP = 0.75
#: Lengths of an edit, as parts of its baseline's, that need no review.
LENGTHS = (0.8, 1.4)

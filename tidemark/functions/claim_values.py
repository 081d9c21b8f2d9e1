"""Fixed values of the claim grammar: entities, synonyms, actions and the wordings that are taken as facts. All must be as they stand for right results."""

ENTITIES = (
    ("vance", r"(?:万斯|(?<![A-Za-z0-9_])(?:jd|j\.d\.)\s+vance(?![A-Za-z0-9_]))"),
    ("trump", r"(?:特朗普|川普|(?<![A-Za-z0-9_])trump(?![A-Za-z0-9_]))"),
    ("iran", r"(?:伊朗|对伊|(?<![A-Za-z0-9_])iran(?![A-Za-z0-9_]))"),
    ("israel", r"(?:以色列|(?<![A-Za-z0-9_])israel(?![A-Za-z0-9_]))"),
    ("fed", r"(?:美联储|(?<![A-Za-z0-9_])(?:fed|fomc)(?![A-Za-z0-9_]))"),
    ("pboc", r"(?:中国人民银行|(?<![A-Za-z0-9_])pboc(?![A-Za-z0-9_]))"),
    ("openai", r"(?:OpenAI|开放人工智能)"),
    ("nvidia", r"(?:英伟达|(?<![A-Za-z0-9_])nvidia(?![A-Za-z0-9_]))"),
    ("tesla", r"(?:特斯拉|(?<![A-Za-z0-9_])tesla(?![A-Za-z0-9_]))"),
    ("apple", r"(?:苹果公司|(?<![A-Za-z0-9_])(?:apple|aapl)(?![A-Za-z0-9_]))"),
    ("meta", r"(?:Meta\s+Platforms|(?<![A-Za-z0-9_])meta(?![A-Za-z0-9_])|脸书)"),
    ("amd", r"(?:(?<![A-Za-z0-9_])amd(?![A-Za-z0-9_])|超威半导体)"),
    ("bitcoin", r"(?:比特币|(?<![A-Za-z0-9_])bitcoin(?![A-Za-z0-9_]))"),
)
#: (pattern, what stands for it).
SYNONYMS = (
    (r"(?:美国|美)副总统", ""),
    (r"(?:j\.d\.|jd)\s*vance", "vance"),
    (r"对伊朗", "对伊"),
    (r"(?:伊朗军事行动|对伊军事行动)", "对伊冲突"),
    (r"(?:并不(?:是|算)|并非|不是|不算)", "非"),
    (r"(?:表示|声称|宣称|说道|说)[:：]?", "称"),
    (r"(?:最新|快讯|突发)[:：]?", ""),
)
PUBLISHER = r"(?:[-–—_|｜]\s*)?(?:路透|reuters|彭博|bloomberg)$"
MODAL = (
    r"(?:可能|或将|预计|预期|计划|拟于?|有望|据悉|传闻|将于|即将|如果|假如|若(?:非)?|是否|考虑|讨论|研究|评估|明天|明年|下周|下月|下季度|下次会议|未来|将(?:会)?(?=.{0,8}(?:降息|加息|发布|推出|召回|增持|减持|买入|卖出))|"
    r"(?<![A-Za-z0-9_])(?:may|might|could|would|will|expects?|expected|plans?|planned|reportedly|rumou?red|set\s+to|scheduled\s+to|forecast(?:s|ed)?|"
    r"likely\s+to|if|next\s+(?:week|month|quarter|year|meeting)|consider(?:s|ed|ing)?|debate(?:s|d|ing)?|weigh(?:s|ed|ing)?|discuss(?:es|ed|ing)?|eye(?:s|d|"
    r"ing)?|explor(?:e|es|ed|ing)|assess(?:es|ed|ing)?|evaluat(?:e|es|ed|ing)|(?:leave(?:s)?|left)\s+(?:the\s+)?door\s+open)(?![A-Za-z0-9_])|[?？])"
)
HISTORICAL = (
    r"(?:此前|曾经?|去年|上月|上季度|上次会议|前次会议|[0-9一二三四五六七八九十]{1,3}月|(?<![A-Za-z0-9_])(?:after|following|previously|earlier|last\s+year|(?:at\s+(?:its\s+)?|"
    r"in\s+(?:its\s+)?)previous\s+meeting|in\s+(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|"
    r"jul|aug|sep|sept|oct|nov|dec))(?![A-Za-z0-9_]))"
)
WAR = r"(?:战争|\bwar\b)"
WAR_DENIED = r"(?:非战争|不是战争|并非战争|not\s+(?:a\s+)?war)"
NEGATION = (
    r"(?:不会|可能不会|不太可能|不再|并未|并没有|未曾|未|没有|暂不|无意|不打算|暂无计划|拒绝|避免|放弃|传闻不实|消息不实|并不属实|系谣言|辟谣|否认(?:将|会)?|\b(?:not|never|without|cannot|can't|unlikely\s+to|"
    r"rules?\s+out|against|refuses?\s+to|refrains?\s+from|avoids?|has\s+no\s+intention\s+of|will\s+not|won't|would\s+not|has\s+not|hasn't|had\s+not|hadn't|"
    r"does\s+not|doesn't|did\s+not|didn't|is\s+not|isn't|are\s+not|aren't|was\s+not|wasn't|were\s+not|weren't|no\s+plans?\s+to|"
    r"not\s+(?:currently\s+)?expected\s+to|den(?:y|ies|ied)\s+(?:it\s+)?(?:will|would|has|had)?))"
)
DENIED = (
    ("rate_cut_denial", r"(?:降息|下调(?:基准|政策)?利率|(?:cut|cuts|cutting|lower|lowers|lowered|lowering)\s+(?:the\s+)?(?:policy\s+)?rates?)"),
    ("rate_hike_denial", r"(?:加息|上调(?:基准|政策)?利率|(?:hike|hikes|hiked|hiking|raise|raises|raised|raising)\s+(?:the\s+)?(?:policy\s+)?rates?)"),
    ("holding_decrease_denial", r"(?:减持|卖出|清仓|削减持仓|(?:trim|trims|trimmed|trimming|sell|sells|sold|selling|cut|cuts|cutting)\s+(?:its\s+)?(?:stake|holding|position|shares?))"),
    ("holding_increase_denial", (
        r"(?:增持|加仓|买入|建仓|(?:buy|buys|bought|buying|add|adds|added|adding|increase|increases|increased|increasing)\s+(?:its\s+)?(?:stake|holding|position|"
        r"shares?))"
    )),
    ("product_recall_denial", r"(?:召回|撤回产品|recall(?:s|ed|ing)?)"),
    ("product_release_denial", r"(?:发布|推出|揭晓|(?:release|releases|released|releasing|launch|launches|launched|launching|unveil|unveils|unveiled|unveiling))"),
)
ACTIONS = (
    ("rate_cut", r"(?:降息|下调(?:基准|政策)?利率|\b(?:cut|cuts|cutting|lowered|lowers)\s+(?:the\s+)?(?:policy\s+)?rates?\b)"),
    ("rate_hike", r"(?:加息|上调(?:基准|政策)?利率|\b(?:hike|hikes|hiked|raise|raises|raised)\s+(?:the\s+)?(?:policy\s+)?rates?\b)"),
    ("rate_hold", r"(?:维持(?:政策)?利率不变|按兵不动|\b(?:keep|keeps|kept|hold|holds|held|leave|leaves|left)\s+(?:the\s+)?(?:policy\s+)?rates?\s+(?:steady|unchanged)\b)"),
    ("product_recall", r"(?:召回|撤回产品|\brecall(?:s|ed|ing)?\b)"),
    ("holding_decrease", r"(?:减持|卖出|清仓|削减持仓|\b(?:trim|trims|trimmed|sell|sells|sold|cuts?)\s+(?:its\s+)?(?:stake|holding|position|shares?)\b)"),
    ("holding_increase", r"(?:增持|加仓|买入|建仓|\b(?:buy|buys|bought|add|adds|added|increase|increases|increased)\s+(?:its\s+)?(?:stake|holding|position|shares?)\b)"),
    ("product_release", r"(?:发布|推出|揭晓|\b(?:release|releases|released|launch|launches|launched|unveil|unveils|unveiled)\b)"),
)
#: The only wordings of an action that are taken as a fact.
FACTS = {
    "rate_cut": (
        (
            r"^(?:the\s+)?(?:fed|fomc|pboc)\s+(?:cuts?|cut|lowers?|lowered)\s+(?:the\s+)?(?:(?:policy|benchmark|key)\s+)?rates?\s+(?:by\s+)?\d+(?:\.\d+)?\s*(?:bps?|"
            r"basis\s+points?)\.?$"
        ),
        r"^(?:美联储|中国人民银行|央行)\s*(?:宣布|决定)?\s*(?:降息|下调(?:基准|政策)?利率)\s*\d+(?:\.\d+)?\s*个?基点[。.!！]?$",
    ),
    "rate_hike": (
        (
            r"^(?:the\s+)?(?:fed|fomc|pboc)\s+(?:hikes?|hiked|raises?|raised)\s+(?:the\s+)?(?:(?:policy|benchmark|"
            r"key)\s+)?rates?\s+(?:by\s+)?\d+(?:\.\d+)?\s*(?:bps?|basis\s+points?)\.?$"
        ),
        r"^(?:美联储|中国人民银行|央行)\s*(?:宣布|决定)?\s*(?:加息|上调(?:基准|政策)?利率)\s*\d+(?:\.\d+)?\s*个?基点[。.!！]?$",
    ),
    "war_denial": (
        r"^(?:美国\s*)?(?:副总统\s*)?万斯\s*(?:表示|声称|宣称|称)?\s*(?:对伊朗?|伊朗)\s*(?:军事行动|冲突)?\s*(?:并非|不是|不算|并不算)\s*(?:一场)?战争[。.!！]?$",
        (
            r"^(?:(?:u\.?s\.?)\s+vice\s+president\s+)?(?:(?:j\.?d\.?)\s+)?vance\s+(?:says?|said|calls?)\s+(?:the\s+)?iran(?:ian)?\s+(?:operation|conflict)\s+(?:is|"
            r"was)\s+not\s+(?:a\s+)?war\.?$"
        ),
    ),
    "product_release": (
        (
            r"^openai\s+(?:releases?|released|launches?|launched|unveils?|unveiled)\s+(?:a\s+|an\s+|the\s+)?(?:(?:gpt[- ]?[a-z0-9.]+)(?:\s+(?:ai\s+)?model)?|"
            r"(?:new\s+)?(?:reasoning|ai|foundation|multimodal)\s+model)(?:\s+(?:for|aimed\s+at)\s+(?:enterprise\s+)?(?:developers?|customers?|users?|"
            r"businesses?))?[.!]?$"
        ),
        r"^(?:openai|开放人工智能)\s*(?:发布|推出|揭晓)\s*(?:新)?(?:gpt[- ]?[a-z0-9.]+(?:\s*模型)?|推理模型|大模型|基础模型|多模态模型)[。.!！]?$",
        r"^(?:新)?(?:推理模型|大模型|基础模型|多模态模型)\s*由\s*(?:openai|开放人工智能)\s*(?:正式)?\s*(?:发布|推出|揭晓)[。.!！]?$",
    ),
}
INFINITIVE = r"(?<![A-Za-z0-9_])to\s+(?:cut|lower|hike|raise|release|launch|unveil|recall|trim|sell|buy|add|increase)(?![A-Za-z0-9_])"
PRODUCT = r"(?<![A-Za-z0-9_])(?:gpt|claude|gemini|llama|iphone|cuda)[- ]?[a-z0-9.]+(?![A-Za-z0-9_])"
REASONING = r"(?:推理模型|reasoning\s+model)"
MODEL = r"(?:大模型|基础模型|\b(?:ai\s+)?model\b)"

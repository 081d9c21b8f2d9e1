"""Fixed values of the relevance rules: who is known by which names, and the patterns of what a text tells. All must be as they stand for right results.

Patterns are read without regard to case (but TICKER), with letters of all scripts as word characters.
"""

#: Names that tell a person for sure.
PERSONS: dict[str, tuple[str, ...]] = {
    "trump": ("Donald Trump", "President Trump", "Trump", "特朗普", "川普"),
    "musk": ("Elon Musk", "Musk", "马斯克"),
    "buffett": ("Warren Buffett", "Buffett", "巴菲特"),
    "dalio": ("Ray Dalio", "Dalio", "瑞达利欧"),
    "duanyongping": ("Duan Yongping", "段永平"),
    "danbin": ("但斌",),
    "renzeping": ("任泽平",),
    "huangrenxun": ("Jensen Huang", "Huang Renxun", "黄仁勋", "NVIDIA CEO"),
    "suzifeng": ("Lisa Su", "苏姿丰", "AMD CEO"),
    "altman": ("Sam Altman", "Altman", "奥尔特曼", "OpenAI CEO"),
    "zuckerberg": ("Mark Zuckerberg", "Zuckerberg", "扎克伯格", "Meta CEO"),
    "powell": ("Jerome Powell", "Powell", "鲍威尔", "Fed Chair", "Federal Reserve Chair"),
    "pangongsheng": ("Pan Gongsheng", "潘功胜", "中国人民银行行长"),
    "dimon": ("Jamie Dimon", "Dimon", "杰米·戴蒙", "JPMorgan CEO"),
    "burry": ("Michael Burry", "迈克尔·伯里"),
    "howardmarks": ("Howard Marks", "霍华德·马克斯"),
    "cathiewood": ("Cathie Wood", "木头姐"),
    "justinsun": ("Justin Sun", "孙宇晨", "孫宇晨", "justinsuntron"),
    "serenity": ("Serenity", "aleabitoreddit", "@aleabitoreddit"),
}
#: Names of companies and institutions of a person: they attribute a text, but are no statement of theirs.
COMPANIES: dict[str, tuple[str, ...]] = {
    "trump": ("Trump Media", "TMTG", "$DJT"),
    "musk": ("Tesla", "特斯拉", "SpaceX", "xAI"),
    "buffett": ("Berkshire Hathaway", "Berkshire", "伯克希尔"),
    "dalio": ("Bridgewater Associates", "Bridgewater", "桥水基金", "桥水"),
    "duanyongping": ("BBK", "步步高", "OPPO", "vivo"),
    "danbin": ("东方港湾", "Oriental Harbor"),
    "huangrenxun": ("NVIDIA", "英伟达"),
    "suzifeng": ("AMD", "Advanced Micro Devices", "超威半导体"),
    "altman": ("OpenAI", "开放人工智能"),
    "zuckerberg": ("Meta Platforms", "Facebook", "脸书", "Meta"),
    "powell": ("Federal Reserve", "the Fed", "美联储"),
    "pangongsheng": ("People's Bank of China", "Peoples Bank of China", "PBOC", "中国人民银行", "央行"),
    "dimon": ("JPMorgan Chase", "JPMorgan", "摩根大通"),
    "burry": ("Scion Asset Management", "Scion"),
    "howardmarks": ("Oaktree Capital", "Oaktree", "橡树资本"),
    "cathiewood": ("ARK Invest", "ARK Investment", "方舟投资"),
    "justinsun": ("TRON DAO", "TRON network", "TRON blockchain", "TRON Foundation", "Tron Inc", "Tron Incorporated", "波场", "波場"),
}
#: Accounts of their own.
HANDLES: dict[str, tuple[str, ...]] = {
    "trump": ("realdonaldtrump",),
    "musk": ("elonmusk",),
    "justinsun": ("justinsuntron",),
    "serenity": ("aleabitoreddit",),
}
#: Persons whose trades tell more: investors, risk, growth and trading.
TRADERS = ("buffett", "dalio", "duanyongping", "danbin", "dimon", "burry", "howardmarks", "cathiewood", "justinsun", "serenity")

DIRECT_SOURCE = r"^(?:truth\s+social|x)\s+@"
TICKER = r"(?<![\w$])\$[A-Z]{1,5}\b"
META_COMPANY = r"(?<![A-Za-z0-9_])meta(?![A-Za-z0-9_]|[-\s]?(?:analysis|analytic|review|study|data|model|learning)\b)"
FINANCE = (
    r"(?:\b(?:stocks?|equities|bonds?|treasur(?:y|ies)|invest(?:or|ors|ing|ment|ments)?|portfolio|ETF|IPO|earnings|revenue|profits?|guidance|valuation|"
    r"dividend|buyback|capex|capital expenditure|cash flow|fiscal|monetary|GDP|econom(?:y|ic)|recession|inflation|deflation|interest rates?|rate cut|"
    r"rate hike|central bank|tariffs?|trade war|export controls?|sanctions?|commodit(?:y|ies)|bitcoin|ethereum|crypto|stablecoins?|forex|currency|"
    r"AI spending|AI investment|supply chain)\b|A股|港股|美股|股票|股份|股价|市场|债券|国债|收益率|基金|投资|大宗商品|比特币|加密货币|稳定币|穩定幣|营收|利润|业绩|指引|估值|分红|回购|资本开支|经济|财政|货币政策|央行|美联储|"
    r"国内生产总值|衰退|通胀|通缩|降息|加息|利率|关税|贸易战|出口管制|制裁|供应链)"
)
FINANCE_CONTEXT = (
    r"\b(?:(?:stock|company|public|listed|common|preferred)\s+shares?|shares?\s+(?:rise|fall|jump|drop|plunge|rally|trade|trading|price|buyback|offering)|"
    r"(?:financial|capital|stock|bond|equity|crypto|commodity|global)\s+markets?|markets?\s+(?:rally|sell[ -]?off|outlook|volatility|liquidity|risk)|"
    r"(?:mutual|hedge|index|pension|sovereign|investment|money market)\s+funds?|(?:asset allocation|asset management|assets under management|"
    r"financial assets?|asset classes?|asset prices?)|(?:crude\s+oil|Brent|WTI)|(?:oil|gold)\s+(?:prices?|futures?|markets?|demand|production|reserves?)|"
    r"(?:customer|chip|semiconductor|vehicle|server|export)\s+orders?|orders?\s+(?:backlog|growth|decline|guidance)|(?:AI|chip|semiconductor|GPU|"
    r"data center|vehicle|consumer|energy|oil)\s+demand|demand\s+(?:forecast|outlook|growth|slowdown)|(?:chip|semiconductor|vehicle|factory|oil|gas|"
    r"industrial)\s+production|(?:semiconductor|chip|GPU|data center)\s+(?:sales|revenue|demand|shipments?|exports?|shortage|investment|capex)|(?:sales|"
    r"revenue|demand|shipments?|exports?|investment|capex)\s+(?:for\s+)?(?:semiconductors?|chips?|GPUs?|data centers?))\b|股票份额|股份价格|资本市场|金融市场|股票市场|资产配置|"
    r"资产管理|资产价格|基金产品|对冲基金|原油价格|黄金价格|原油期货|黄金期货|共同基金|客户订单|订单积压|芯片需求|算力需求|汽车产量|芯片产量"
)
GEO_CONTEXT = (
    r"\b(?:Iran|Israel|Ukraine|Russia|Taiwan|China|Middle East|NATO|military|nuclear|missile|invasion|geopolitic(?:al|s)?|armed conflict)\b|伊朗|以色列|乌克兰|俄罗斯|"
    r"台海|台湾|中东|北约|军事|核武|导弹|入侵|地缘"
)
WAR = r"\bwar\b|战争|战事|冲突"
NON_GEO_WAR = r"\b(?:culture|console|streaming|browser|format|talent|price)\s+war\b|文化战争|价格战"
PHYSICAL_CRASH = (
    r"\b(?:train|tractor|car|vehicle|truck|bus|plane|aircraft|helicopter|road|highway|rollover|collision|traffic)\b.{0,45}\b(?:crash|accident|collision|"
    r"strikes?|hit)\b|\b(?:crash|accident|collision)\b.{0,45}\b(?:train|tractor|car|vehicle|truck|bus|plane|aircraft|helicopter|road|highway|traffic)\b|"
    r"(?:火车|拖拉机|汽车|车辆|卡车|公交车|飞机|直升机|道路|公路).{0,20}(?:事故|相撞|撞击|撞上|车祸|空难)|(?:事故|相撞|撞击|车祸|空难).{0,20}(?:火车|拖拉机|汽车|车辆|卡车|公交车|飞机|直升机|道路|公路)"
)
MARKET_SHOCK = (
    r"(?:\b(?:stocks?|shares?|equities|markets?|crypto|bitcoin|bonds?|prices?|assets?)\b.{0,35}\b(?:crash(?:es|ed|ing)?|collapse(?:s|d)?|plunge(?:s|d)?|"
    r"sell[ -]?off|panic)\b|\b(?:crash(?:es|ed|ing)?|collapse(?:s|d)?|plunge(?:s|d)?|sell[ -]?off|panic)\b.{0,35}\b(?:stocks?|shares?|equities|markets?|"
    r"crypto|bitcoin|bonds?|prices?|assets?)\b|(?:股市|股票|股价|市场|加密货币|比特币|债券|资产).{0,20}(?:崩盘|暴跌|崩溃|恐慌|抛售)|(?:崩盘|暴跌|崩溃|恐慌|抛售).{0,20}(?:股市|股票|股价|市场|加密货币|比特币|债券|"
    r"资产))"
)
BUBBLE_CRISIS = (
    r"(?:\b(?:financial|banking|debt|credit|liquidity|economic|sovereign|housing|property|stock|market|crypto|AI|tech)\b.{0,30}\b(?:crisis|bubble|panic|"
    r"collapse)\b|\b(?:crisis|bubble|panic|collapse)\b.{0,30}\b(?:financial|banking|debt|credit|liquidity|economic|sovereign|housing|property|stock|market|"
    r"crypto|AI|tech)\b|(?:金融|银行|债务|信贷|流动性|经济|主权|房地产|楼市|股市|市场|加密|AI|科技).{0,20}(?:危机|泡沫|恐慌|崩溃)|(?:危机|泡沫|恐慌|崩溃).{0,20}(?:金融|银行|债务|信贷|流动性|经济|主权|房地产|楼市|股市|市场|"
    r"加密|AI|科技))"
)
RATE_DECISION = (
    r"\b(?:Fed|Federal Reserve|central bank)\b.{0,45}\b(?:cuts?|raises?|hikes?|reduces?)\b.{0,20}\b(?:rates?|basis points?|bps)\b|\b(?:cuts?|raises?|hikes?|"
    r"reduces?)\b.{0,20}\b(?:interest rates?|basis points?|bps)\b|(?:美联储|央行).{0,30}(?:降息|加息)|(?:降息|加息).{0,30}(?:基点|利率)"
)
TARIFF_ACTION = (
    r"\b(?:impose|announce|raise|increase|double|slash|remove|delay)s?\b.{0,40}\btariffs?\b|\b\d{1,3}%\s+tariffs?\b|(?:宣布|加征|提高|取消|暂缓).{0,25}关税|"
    r"\d{1,3}%[^。；,，]{0,12}关税"
)
SYSTEMIC = r"\b(?:recession|depression|sovereign default|bank run|systemic risk)\b|经济衰退|经济萧条|主权违约|银行挤兑|系统性风险"
MEDIUM = r"\b(?:warning|warns?|alert|caution|risk|slowdown|inflation|deflation|tariffs?|trade war|shortage|layoffs?)\b|预警|警告|风险|放缓|减速|通胀|通缩|关税|贸易战|短缺|裁员"
CORPORATE_ACTION = (
    r"\b(?:launch(?:es|ed|ing)?|unveil(?:s|ed)?|announce(?:s|d)?|release(?:s|d)?|describ(?:e|es|ed|ing)|present(?:s|ed|ing)?|demonstrat(?:e|es|ed|ing)|"
    r"partner(?:s|ed|ship)?|acquire(?:s|d)?|acquisition|merge(?:s|d|r)?|merger|(?:sign(?:s|ed)?|win(?:s)?|won)\b.{0,30}\b(?:a\s+)?contract|expand(?:s|ed|"
    r"ing)?|expansion|restructur(?:e|es|ed|ing)|delay(?:s|ed|ing)?|recall(?:s|ed|ing)?|layoffs?|lays?\s+off|appoint(?:s|ed)?|faces?\s+(?:a\s+)?(?:lawsuit|"
    r"probe|investigation)|sued|investigat(?:e|es|ed|ing))\b|发布|推出|宣布|介绍|展示|上市|合作|收购|并购|(?:签署|赢得|获得).{0,8}合同|扩产|扩张|推迟|延期|召回|降价|重组|裁员|任命|遭到.{0,8}(?:诉讼|调查)|"
    r"被(?:起诉|调查)"
)
TRADE_ACTION = (
    r"\b(?:buy|buys|bought|sell|sells|sold|add|adds|added|trim|trims|trimmed|reduce|reduces|reduced|increase|increases|increased|short|shorts|shorted|long|"
    r"longs|longed|exit|exits|exited)\b|买入|卖出|增持|加仓|减持|减仓|做多|做空|清仓|退出"
)
BUSINESS_OBJECT = (
    r"\b(?:product|platform|model|processor|chip|GPU|semiconductor|factory|data center|software|service|startup|company|partnership|acquisition|merger|"
    r"contract|stake|position|holding|exposure|shares?|stock|OpenAI|GPT[- ]?\d*|Grok(?:\s+\d+)?|NVIDIA|AMD|Meta|Tesla|SpaceX|xAI|Apple|NVDA|TSLA|AAPL|MSFT|"
    r"GOOGL|GOOG|AMZN|DJT|SPY|QQQ|BTC|ETH)\b|产品|平台|模型|处理器|芯片|算力|半导体|工厂|数据中心|软件|服务|公司|合作|收购|并购|合同|股份|持仓|仓位|敞口|英伟达|特斯拉|苹果"
)
POSITION_OBJECT = r"\b(?:stake|position|holding|exposure|shares?|stocks?|portfolio|NVDA|TSLA|AMD|META|AAPL|MSFT|GOOGL|GOOG|AMZN|DJT|SPY|QQQ|BTC|ETH)\b|股份|股票|持仓|仓位|敞口|投资组合"
CORPORATE_EVENT = (
    r"\b(?:funding|financing|capital raising|fundraising)\s+(?:round|deal)|\b(?:raises?|raised|secures?|secured)\b.{0,18}\b(?:funding|financing|capital)\b|"
    r"融资轮|融资交易|完成.{0,8}融资|获得.{0,8}融资|融资"
)
BUSINESS_METRIC = (
    r"\b(?:shipments?|deliveries|delivery estimates?|margins?|backlog|bookings|(?:vehicle|company|product|unit)\s+sales|market share|"
    r"prices?)\b.{0,24}\b(?:ramp(?:s|ed|ing)?|rise|rises|rose|grow|grows|grew|gain|gains|gained|improve|improves|improved|fall|falls|fell|decline|declines|"
    r"declined|slow|slows|slowed|miss|misses|missed|cut|cuts|cutting)\b|\b(?:ramp(?:s|ed|ing)?|rise|rises|rose|grow|grows|grew|improve|improves|improved|"
    r"gain|gains|gained|fall|falls|fell|decline|declines|declined|miss|misses|missed|cut|cuts|cutting)\b.{0,24}\b(?:shipments?|deliveries|"
    r"delivery estimates?|margins?|backlog|bookings|(?:vehicle|company|product|unit)\s+sales|market share|prices?)\b|(?:出货|交付|交付预期|毛利率|利润率|订单积压|预订量|销量|市占率|"
    r"价格).{0,12}(?:增长|上升|提升|改善|加速|下滑|下降|放缓|不及|未达|降价)|(?:增长|上升|提升|改善|加速|下滑|下降|放缓|不及|未达|降价).{0,12}(?:出货|交付|交付预期|毛利率|利润率|订单积压|预订量|销量|市占率|价格)"
)
CAPITAL_ALLOCATION = (
    r"\b(?:raise|raises|raised|increase|increases|increased|cut|cuts|cutting|reduce|reduces|reduced)\b.{0,18}\b(?:capex|capital expenditure|investment|"
    r"spending)\b|\b(?:capex|capital expenditure|investment|spending)\b.{0,18}\b(?:rise|rises|rose|increase|increases|increased|fall|falls|fell|decline|"
    r"declines|declined|cut|cuts|reduced)\b|(?:提高|增加|上调|削减|降低|下调).{0,10}(?:资本开支|资本支出|投资额)|(?:资本开支|资本支出|投资额).{0,10}(?:提高|增加|上调|削减|降低|下调)"
)
RATE_HOLD = (
    r"\b(?:hold|holds|held|keep|keeps|kept|leave|leaves|left)\b.{0,20}\b(?:interest\s+)?rates?\b.{0,12}\b(?:steady|unchanged)\b|"
    r"\b(?:interest\s+)?rates?\b.{0,12}\b(?:remain|remains|stay|stays)\b.{0,8}\b(?:steady|unchanged)\b|维持.{0,10}利率.{0,6}不变|利率.{0,10}(?:维持不变|保持不变|按兵不动)"
)
NON_BUSINESS = (
    r"\b(?:oil\s+painting|personal\s+assets?|book\s+sales?|charity\s+platform|museum|exhibition|baby|newborn|custody|divorce|toy|pie|lunch|daughter|son|"
    r"birthday|wedding|school|teaching|heart\s+rate|(?:buys?|bought|wears?|gifts?)\s+(?:an?\s+)?Apple\s+Watch|holiday\s+(?:party|dinner|video)|"
    r"family\s+(?:photo|photos|dinner))\b|油画|个人资产|离婚|监护权|图书销量|慈善平台|博物馆|展览|婴儿|新生儿|玩具|馅饼|午餐|女儿|儿子|生日|婚礼|学校|教学|心率|节日视频|家庭照片|家庭聚餐"
)
ACCIDENT_CONSEQUENCE = r"\b(?:stocks?|shares?|markets?|earnings|revenue|production|operations?|supply chain|factory|plant|shipment|sales)\b|股票|股价|市场|业绩|营收|生产|运营|供应链|工厂|出货|销量"
AMBIGUOUS_FINANCE = (
    r"\bbonds?\s+with\b|\bstocks?\s+(?:up\s+on|(?:the\s+)?(?:pantry|shelves?|store|warehouse))\b|\bportfolio\s+of\s+(?:watercolou?r|oil|art|paintings?|"
    r"photos?|photographs?)\b|\beconomy\s+class\b|菜市场|人才市场|农贸市场|跳蚤市场|经济舱|基金会"
)
#: "Trump" as a verb, and a company named like a person.
TRUMP_VERB = (
    r"\b(?:stocks?|equities|shares?|markets?|returns?|earnings|profits?|cash|gold|oil|growth|value|performance|fundamentals)(?:\s+(?:may|might|can|could|"
    r"will|would|should|still|easily|clearly|consistently|often|usually|historically|probably|likely|continue(?:s|d)?|are|is|set|poised|expected|"
    r"to)){0,4}\s+trump\s+(?:bonds?|treasur(?:y|ies)|peers?|cash|gold|oil|growth|value|returns?|risk|quality|politics|polls?|fundamentals|fixed\s+income|"
    r"other\s+assets?)\b"
)
POWELL_COMPANY = r"\s+(?:Industries|Company|Corp(?:oration)?|Inc\.?|LLC)\b"

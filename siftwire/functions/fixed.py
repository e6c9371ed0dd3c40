"""Word lists, ordered (label, pattern) rules, weights and thresholds that results depend on. All are defaults of
rules that callers may replace."""

# Query parameters that do not belong to an address.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "ref_src", "cmpid")

# Evidence types and their weights.
EVIDENCE_WEIGHTS = {
    "official_announcement": 100, "financial_report": 95, "regulatory_document": 95, "research_paper": 90, "data_release": 90, "reliable_media_report": 80,
    "industry_analysis": 70, "market_feedback": 70, "expert_opinion": 60, "social_discussion": 40, "unknown": 20,
}

# Categories derived from text, in order, with the label of the area they touch.
DERIVED_CATEGORIES = (
    ("macro", "宏观", r"(\bgdp\b|\binflation\b|\bcpi\b|\bppi\b|\bfomc\b|federal reserve|central bank|rate decision|interest rate|\brate\b|treasury|财政|货币政策|宏观|通胀|物价|利率|降息|加息|央行|人民银行|美联储|国债|预算|统计局|经济运行)"),
    ("international", "国际", r"(\bglobal\b|\bworld\b|international|geopolitic|diplomacy|sanction|tariff|\bwar\b|conflict|election|foreign|联合国|国际|全球|外交|地缘|制裁|关税|战争|冲突|选举|海外)"),
    ("business", "商业", r"(\bearnings\b|\brevenue\b|\bprofit\b|\bcompany\b|\bstartup\b|\bipo\b|\bmerger\b|\bacquisition\b|\benterprise\b|\bbusiness\b|\bretail\b|\bconsumer\b|财报|营收|利润|公司|企业|商业|并购|上市|创业|消费|零售|国企|民企)"),
)

# Patterns of source names and kinds.
TIER_A_NAMES = r"(reuters|associated press|\bap\b|financial times|\bft\b|bloomberg|bbc|dow jones|wall street journal|wsj)"
TIER_C_WORDS = r"blog|substack|newsletter|social|forum|x\.com|twitter|reddit|opinion|commentary"
TIER_D_WORDS = r"marketing|sponsored|coupon|deal|promo|aggregator|scraper|content farm"

# Patterns of evidence.
FINANCIAL_WORDS = r"sec|csrc|exchange|交易所|公告|披露|filing|10-k|10-q|8-k|earnings|revenue|profit|financial report|财报|营收|利润"
REGULATORY_WORDS = r"regulation|regulatory|rule|监管|条例|办法|政策|央行|federal reserve|sec|csrc"
ANNOUNCEMENT_WORDS = r"official announcement|press release|公告|发布|声明"
PAPER_WORDS = r"paper|journal|arxiv|research|论文|研究"
DATA_WORDS = r"data|dataset|统计|数据|cpi|gdp|inflation|employment|retail sales"
ANALYSIS_WORDS = r"analysis|research note|industry|报告|分析|研报"
MARKET_WORDS = r"market|stock|share|yield|price|成交|股价|市场|收益率"
OPINION_WORDS = r"opinion|commentary|expert|观点|评论|专家"
SOCIAL_WORDS = r"social|reddit|twitter|x\.com|discussion|讨论"

# Event relevance.
ENTITY_PATTERNS = (r"\bopenai\b|\bnvidia\b|\bfederal reserve\b|\bfed\b|\bsec\b|\bcsrc\b", r"英伟达|美联储|证监会|央行|国务院|国家统计局|发改委|交易所|监管")
RELEVANT_FACTS = r"发布|announced|reported|data|数据|公告|披露|confirmed|批准|released"

# Event types, in order.
EVENT_TYPES = (
    ("promotion", r"招聘|诚聘|促销|优惠|折扣|报名|活动预告|会议预告|coupon|promo|sponsored|giveaway|job opening|hiring"),
    ("security_incident", r"漏洞|攻击|入侵|泄露|安全事件|breach|cyberattack|vulnerability|ransomware|zero-day"),
    ("policy_change", r"政策|监管|法规|法案|条例|规则|制裁|批准|禁令|regulation|policy|law|rule|sanction|ban|approved"),
    ("earnings_guidance", r"财报|营收|利润|亏损|指引|earnings|revenue|profit|guidance|quarterly results"),
    ("economic_data", r"gdp|cpi|ppi|通胀|就业|失业|零售销售|经济数据|industrial production|payroll"),
    ("product_launch", r"发布|推出|上线|正式开放|launch|released|unveiled|introduces|announces.*product"),
    ("technology_upgrade", r"升级|更新|新版本|性能提升|架构|模型能力|upgrade|update|new version|architecture|benchmark"),
    ("research_result", r"研究|论文|实验|临床|发现|research|paper|study|journal|arxiv|trial"),
    ("market_move", r"大涨|大跌|暴跌|暴涨|新高|新低|熔断|波动|surge|plunge|selloff|record high|market move"),
    ("commentary", r"评论|观点|解读|专栏|opinion|commentary|analysis"),
    ("company_update", r"公司|企业|任命|合作|扩张|裁员|company|appoint|partnership|expansion|layoff"),
)
PRIORITY_EVENT_TYPES = ("policy_change", "product_launch", "technology_upgrade", "earnings_guidance", "economic_data", "market_move", "security_incident", "research_result")
CRITICAL_EVENT_TYPES = ("policy_change", "economic_data", "security_incident")
VERIFIABLE_FACTS = r"\b\d+(?:\.\d+)?%?\b|20\d{2}|宣布|发布|批准|确认|报告|数据显示|announced|released|approved|confirmed|reported|data show"
TOPIC_WORDS = r"人工智能|芯片|模型|市场|利率|经济|政策|监管|科学|安全|AI|chip|market|policy|science|security"
CLUSTER_STOPWORDS = ("the", "and", "with", "from", "after", "new", "update", "report", "announces", "发布", "宣布", "最新", "相关", "公司")
BLOCKED_PATTERNS = ("招聘", "诚聘", "促销", "优惠", "折扣", "报名", "活动预告", "会议预告", "教程", "入门指南", "how to", "tutorial", "webinar", "register now", "coupon", "sponsored", "giveaway", "job opening", "hiring")

# Filter lists.
BLOCKED_TERMS = ("celebrity gossip", "horoscope", "coupon", "giveaway", "sponsored post")
LOW_VALUE_TITLES = ("sponsored", "daily deals", "coupon", "promo code", "rumor roundup", "震惊", "必看", "重磅爆料")
LOW_VALUE_CONTENT = ("sponsored by", "affiliate link", "not financial advice", "未经证实", "网传")
LONG_LIVED_WORDS = r"政策|监管|研究|论文|经济数据|policy|regulation|research|paper|economic data"
NAVIGATION_TITLES = r"^(首页|更多|加载更多|联系我们|网站地图|English|EN|简|繁|无障碍)$"

# Category patterns and boosts by event type.
CATEGORY_PATTERNS = (
    ("technology", r"人工智能|大模型|模型|软件|硬件|芯片|云计算|开发者|技术升级|AI|model|software|hardware|chip|cloud|developer|technology"),
    ("finance", r"股价|债券|基金|融资|估值|投资|资金流|交易|资产价格|stock|bond|fund|financing|valuation|investment|market price"),
    ("business", r"财报|营收|利润|成本|市场份额|公司战略|并购|经营|earnings|revenue|profit|cost|market share|merger|business"),
    ("macro", r"国内生产总值|通胀|就业|失业|利率|货币政策|经济数据|gdp|cpi|ppi|inflation|employment|interest rate|monetary policy"),
    ("policy", r"政策|监管|法律|法规|政府措施|产业政策|审批|policy|regulation|law|government|antitrust"),
    ("international", r"国际关系|外交|战争|冲突|制裁|关税|跨境|联合国|geopolit|diplom|war|conflict|sanction|tariff|cross-border|united nations"),
    ("science", r"科学|研究成果|论文|实验|临床试验|太空|物理|生物|research result|paper|experiment|clinical trial|space|physics|biology"),
    ("security", r"网络安全|漏洞|攻击|入侵|泄露|恶意软件|security|vulnerability|breach|cyberattack|malware|ransomware"),
)
EVENT_CATEGORY_BOOSTS = {
    "security_incident": ("security", 0.5), "policy_change": ("policy", 0.45), "economic_data": ("macro", 0.45), "earnings_guidance": ("business", 0.45),
    "research_result": ("science", 0.4), "market_move": ("finance", 0.35), "technology_upgrade": ("technology", 0.35), "product_launch": ("technology", 0.25),
}
SOURCE_CATEGORIES = {"tech": "technology", "finance": "finance", "business": "business", "macro": "macro", "international": "international", "news": "policy"}
DISPLAY_CHANNELS = {"technology": "tech", "finance": "finance", "business": "business", "macro": "macro", "policy": "news", "international": "international", "science": "tech", "security": "tech"}

# Secondary tags.
SECONDARY_TAGS = (
    ("人工智能", r"人工智能|大模型|\bAI\b|artificial intelligence"),
    ("芯片与算力", r"芯片|半导体|算力|GPU|semiconductor|compute"),
    ("软件与开发者", r"软件|开发者|开源|API|software|developer|open source"),
    ("网络安全", r"网络安全|漏洞|攻击|泄露|cyber|security|vulnerability|breach"),
    ("产业政策", r"产业政策|补贴|产业规划|industrial policy|subsidy"),
    ("监管执法", r"监管|执法|反垄断|regulation|enforcement|antitrust"),
    ("货币政策", r"央行|利率|货币政策|central bank|interest rate|monetary policy"),
    ("经济数据", r"GDP|CPI|PPI|通胀|就业|经济数据|inflation|employment"),
    ("资本市场", r"股价|债券|基金|交易所|stock|bond|fund|exchange"),
    ("融资与并购", r"融资|估值|投资|并购|financing|valuation|investment|merger"),
    ("财报与指引", r"财报|营收|利润|指引|earnings|revenue|profit|guidance"),
    ("国际贸易", r"关税|出口|进口|贸易|tariff|export|import|trade"),
    ("地缘政治", r"外交|战争|冲突|制裁|geopolit|war|conflict|sanction"),
    ("科研成果", r"论文|实验|研究成果|paper|experiment|research result"),
)
FACTOR_PATTERNS = {
    "subject": r"([A-Z][A-Za-z0-9 .&-]{2,}|[\x{4e00}-\x{9fff}]{2,}(?:公司|部门|委员会|银行|政府|大学))",
    "action": r"(?i)(发布|推出|批准|宣布|报告|升级|投资|收购|监管|released|launched|approved|announced|reported|upgraded|invested|acquired)",
    "object": r"(?i)(模型|产品|政策|市场|公司|经济|研究|安全|model|product|policy|market|company|economy|research|security)",
    "impact": r"(?i)(影响|导致|推动|限制|提高|降低|impact|cause|drive|limit|increase|decrease)",
}
NO_FACTOR = "证据中未明确说明"

# Content density.
BODY_FACTS = r"宣布|发布|批准|确认|报告|数据显示|表示|指出|要求|强调|实施|启动|完成|交付|增长|下降|announced|released|approved|confirmed|reported|stated|launched|implemented|completed|delivered|increased|decreased"
BODY_NUMBERS = r"\b\d+(?:\.\d+)?%?\b|20\d{2}"
BODY_ENTITIES = r"[A-Z][A-Za-z]{2,}|[\x{4e00}-\x{9fff}]{2,}(?:公司|部门|委员会|银行|政府|大学)|国务院|证监会|人民银行|科技部|财政部|国家统计局|发展改革委"
BODY_EVIDENCE = r"公告|原文|文件|会议|调研|部署|论文|研究|filing|paper|study|official|report"

# Keywords.
ENGLISH_STOPWORDS = ("about", "after", "again", "also", "amid", "from", "have", "into", "more", "news", "over", "said", "says", "that", "their", "this", "with", "will", "your")
FINE_KEYWORDS = (
    ("AI芯片", r"(ai chip|gpu|nvidia|semiconductor|accelerator|芯片|算力|英伟达)"),
    ("AI政策", r"(ai policy|artificial intelligence|regulation|safety|governance|监管|安全)"),
    ("美联储", r"(federal reserve|fed\b|fomc|powell|美联储|联邦储备)"),
    ("央行", r"(central bank|人民银行|央行|利率|降息|加息)"),
    ("财报", r"(earnings|revenue|profit|guidance|quarter|财报|营收|利润)"),
    ("地缘政治", r"(geopolitic|sanction|tariff|war|conflict|election|diplomacy|制裁|关税|冲突|选举|外交)"),
    ("消费电子", r"(apple|iphone|android|device|consumer electronics|pc|smartphone|消费电子|手机|电脑)"),
    ("公共政策", r"(policy|government|国务院|财政|补贴|规划|公共|民生)"),
    ("市场监管", r"(sec|csrc|监管|证券|交易所|market structure|披露)"),
)
TECHNICAL_LABELS = ("official-agency", "official-market", "official-media", "media", "daily", "hourly", "realtime")

# Score weights.
CATEGORY_BOOSTS = {"tech": 2, "finance": 3, "business": 2, "macro": 4, "international": 2, "news": 1}
SOURCE_BOOSTS = {"Federal Reserve": 4, "U.S. SEC Press Releases": 4, "中国人民银行新闻发布": 5, "中国证监会新闻发布": 5, "中国政府网要闻": 4}
AUTHORITY_BOOSTS = {"official-agency": 5, "official-market": 4, "official-media": 3, "media": 0}
TIER_BOOSTS = {"S": 8, "A": 5, "B": 2, "C": -18, "D": -50}
EVIDENCE_BOOSTS = {
    "official_announcement": 8, "financial_report": 7, "regulatory_document": 7, "research_paper": 6, "data_release": 6, "reliable_media_report": 4,
    "industry_analysis": 2, "market_feedback": 2, "expert_opinion": -5, "social_discussion": -12, "unknown": -10,
}
TIMELINESS_BOOSTS = {"realtime": 4, "hourly": 3, "daily": 1, "periodic": 0}
KEYWORD_SCORES = (
    ("AI", 8), ("artificial intelligence", 8), ("security", 6), ("chip", 5), ("regulation", 6), ("central bank", 8), ("inflation", 6), ("market structure", 7), ("election", 5), ("policy", 4),
    ("earnings", 5), ("GDP", 6), ("tariff", 5), ("财报", 5), ("宏观", 6), ("国际", 4), ("breach", 8), ("sanction", 6), ("default", 7), ("recall", 5),
)

# Hotspots.
MARKET_POOL = r"market|stock|share|股价|成交|市场|利率|通胀|监管|政策|开发者|官方回应"
UNCERTAIN_POOL = r"不足以判断|无法确认|未证实|传闻|rumor"
EMPTY_TEXT = r"(?i)不足以判断|暂无|unknown"
CLICKBAIT = r"震惊|爆炸|史诗级|重磅突发|必看|狂飙|!{2,}|？{2,}|\?{2,}"

# Search aliases.
TERM_ALIASES = {
    "ai": ("人工智能", "大模型", "生成式ai", "artificial intelligence"),
    "人工智能": ("ai", "大模型", "artificial intelligence"),
    "芯片": ("chip", "semiconductor", "gpu", "半导体"),
    "半导体": ("chip", "semiconductor", "芯片"),
    "金融": ("finance", "market", "市场", "监管"),
    "宏观": ("macro", "gdp", "inflation", "通胀", "利率", "央行", "美联储"),
    "商业": ("business", "company", "earnings", "财报", "企业", "公司"),
    "国际": ("global", "world", "international", "外交", "地缘", "制裁"),
    "政策": ("policy", "regulation", "监管"),
    "监管": ("regulation", "policy", "sec", "csrc", "证监会"),
}

# Further search aliases.
DECISION_TERM_ALIASES = {
    "spacex": ("space x", "starship", "starlink", "tsla", "tesla", "elon musk", "musk", "nasa", "faa", "fcc", "马斯克", "特斯拉"),
    "马斯克": ("elon musk", "musk", "spacex", "starship", "starlink", "tsla", "tesla", "nasa", "faa", "fcc"),
    "musk": ("elon musk", "spacex", "starship", "starlink", "tsla", "tesla"),
    "tesla": ("tsla", "特斯拉", "elon musk", "musk", "spacex"),
    "tsla": ("tesla", "特斯拉", "elon musk", "spacex"),
    "nvidia": ("nvda", "英伟达", "gpu", "chip", "semiconductor", "smh"),
    "nvda": ("nvidia", "英伟达", "gpu", "chip", "semiconductor", "smh"),
    "英伟达": ("nvidia", "nvda", "gpu", "chip", "semiconductor", "smh"),
    "openai": ("ai", "artificial intelligence", "microsoft", "msft", "人工智能", "大模型"),
    "人工智能": ("ai", "artificial intelligence", "openai", "nvidia", "nvda", "google", "microsoft"),
    "国务院": ("中国政府网", "政策", "落地"),
    "证监会": ("csrc", "sec", "监管", "美股", "中国政策"),
    "人民银行": ("pbc", "central bank", "央行", "政策", "利率"),
    "发改委": ("ndrc", "政策", "产业"),
    "财政部": ("mof", "政策", "财政"),
    "科技部": ("most", "ai", "科技", "人工智能"),
    "工信部": ("miit", "ai", "算力", "芯片", "产业"),
}
AUTHORITATIVE = ("official-agency", "official-market", "official-media", "financial-media")

# A day named in a watch row.
DATED = r"\d{4}[-年/]\d{1,2}|\d{1,2}月\d{1,2}日|明日|下周[一二三四五六日]"

# Weekly data labels.
SIGNAL_LEVELS = ("strong", "medium", "weak", "unconfirmed")

# Words without evidence, cut from extracted data.
HYPE_TERMS = ("重大", "革命性", "颠覆性", "史诗级", "爆炸性", "game-changing", "revolutionary", "disruptive")

# Stages of progress, in order.
STAGES = (
    ("rumor", r"传闻|据悉|rumou?r|reportedly"),
    ("proposed", r"提议|拟议|计划|proposal|proposed|plans? to"),
    ("under_review", r"审议|谈判|调查|征求意见|under review|negotiat|investigat|consultation"),
    ("implemented", r"已实施|已生效|正式施行|implemented|took effect|effective from"),
    ("in_progress", r"开始执行|正在实施|正在推进|in progress|rolling out"),
    ("initial_result", r"初步结果|数据显示|首次结果|initial result|early result"),
    ("announced", r"发布|宣布|批准|公布|released|announced|approved|published"),
)

"""Rule sets as data.  All lists are parameters of the operators; these are the shipped ones.

Fixed values: the patterns, labels, weights, windows and limits below must equal those
that results are compared with.
"""

from __future__ import annotations

DOCUMENT_TYPES = ("guideline", "consensus", "statement", "practice_advisory", "safety_alert", "quality_indicator", "research_article", "news", "video", "education", "policy", "unknown")
FORMAL_TYPES = ("guideline", "consensus", "statement", "practice_advisory", "safety_alert", "quality_indicator", "policy")
GUIDANCE_TYPES = ("guideline", "consensus", "statement", "practice_advisory", "quality_indicator")

#: Content that never enters review.
HARD_EXCLUDED = (
    r"\b(?:advertisement|advertising|advert|commercial promotion|sponsor(?:ed|ship)?)\b",
    r"\b(?:career|careers|job opening|hiring|recruit(?:ment|ing)?)\b",
    r"\b(?:procurement|purchasing|tender|bid)\b",
    r"\b(?:registration|register|sign[- ]?up)\b",
    r"\bpatient (?:education|information)\b",
    r"\b(?:hospital|clinic|department)\s+(?:promotion|publicity)\b|(?:广告|赞助|招聘|招募|采购|报名|患者科普|患者教育|病人科普|病人教育|医院宣传|科室宣传|无实质(?:内容|活动))|\bno substantive (?:content|activity)\b",
)
HARD_EXCLUDED_KIND = (
    ("education", r"\b(?:registration|register|sign[- ]?up|patient (?:education|information)|course|training|workshop)\b|(?:报名|患者科普|患者教育|病人科普|病人教育)"),
    ("video", r"\b(?:webinar|video|podcast|recording)\b"),
)
#: Document type by title, first match wins.
TITLE_TYPES = (
    ("practice_advisory", r"\bpractice advisory\b"),
    ("safety_alert", r"\b(?:patient )?safety alert(?:s)?\b"),
    ("consensus", r"\b(?:clinical |obstetric care )?consensus(?: statement)?\b"),
    ("guideline", r"\b(?:clinical |practice |green-top )?guideline(?:s)?\b"),
    ("guideline", r"\b(?:consult series|scientific impact paper|good practice paper)\b"),
    ("statement", r"\b(?:committee|joint|position|special)?\s*statement\b"),
    ("statement", r"\b(?:committee opinion|position document)\b"),
    ("quality_indicator", r"\bquality indicators?\b"),
    ("policy", r"\bpolicy(?: document)?\b"),
    ("practice_advisory", r"(?:临床)?实践公告"),
    ("safety_alert", r"(?:安全提醒|安全警示)"),
    ("consensus", r"(?:专家|临床)?共识"),
    ("guideline", r"(?:临床|诊疗|实践|技术)?指南|推荐(?:意见|建议)"),
    ("statement", r"(?:正式|联合|立场)?声明|立场文件"),
    ("quality_indicator", r"(?:质量指标|质量评价指标)"),
    ("policy", r"(?:政策文件|管理规范|技术规范|临床规范|诊疗规范|工作规范|规范性文件)"),
    ("education", r"\b(?:registration|course|training|workshop|education|learning)\b"),
    ("video", r"\b(?:video|webinar|podcast|recording)\b"),
    ("news", r"\b(?:news|news release|press release|announcement|update)\b"),
)
#: Professional content type, first match wins.
CONTENT_TYPES = (
    ("expert_commentary_on_guideline", r"\bexpert commentary on (?:a )?guideline\b|指南专家解读"),
    ("practice_bulletin_summary", r"\bpractice bulletin summary\b|实践公告解读"),
    ("guideline_interpretation", r"\bguideline interpretation\b|指南解读|共识解读"),
    ("guideline_summary", r"\bguideline summary\b|指南摘要"),
    ("guideline_update", r"\bguideline update\b|指南更新"),
    ("clinical_practice_recommendation", r"\bclinical practice recommendation\b|诊疗规范|临床路径|临床实践建议"),
    ("video_article", r"\b(?:video article|surgical video)\b"),
    ("technical_note", r"\btechnical note\b|技术札记|技术说明"),
    ("step_by_step_procedure", r"\bstep[- ]by[- ]step (?:procedure|surgery|technique)\b|分步手术|手术步骤解析"),
    ("operative_tips", r"\b(?:operative|surgical) tips\b|手术技巧"),
    ("complication_prevention", r"\b(?:surgical )?complication prevention\b|并发症防治"),
    ("surgical_approach", r"\bsurgical approach\b|手术入路"),
    ("anatomy_for_surgery", r"\b(?:surgical anatomy|anatomy for surgery)\b|手术解剖"),
    ("surgical_review", r"\bsurgical review\b|手术难点解析|专家手术点评"),
    ("surgical_technique", r"\b(?:surgical|operative) technique\b|\binstruments? and techniques?\b|手术技术|术式|操作技术"),
    ("safety_alert", r"\b(?:patient )?safety alert\b|安全提醒|安全警示"),
    ("guideline_implementation", r"\bguideline implementation\b|指南实施"),
    ("practice_change", r"\bpractice change\b|\bguidance implementation\b|实践变更|指南实施"),
    ("quality_improvement", r"\bquality improvement\b|质量改进"),
    ("clinical_service_update", r"\bclinical service update\b|临床服务更新"),
    ("clinical_update", r"\bclinical (?:practice |service )?update\b|临床更新|临床实践更新"),
    ("society_update", r"\b(?:society|association|professional organi[sz]ation) (?:news|update)\b|学会动态|协会动态"),
    ("policy_update", r"\b(?:policy|regulatory) update\b|政策更新|监管更新"),
    ("academic_update", r"\bacademic update\b|学术动态|学术活动总结"),
    ("substantive_conference_result", r"\bconference (?:results?|findings?) (?:summary|report)\b|会议结果摘要|会议成果总结"),
    ("professional_review", r"\b(?:narrative|clinical(?: practice)?|expert) review\b|\b(?:professional|clinical) review\b|\breview article\b|叙述性综述|临床综述|临床实践综述|专家综述|专业综述"),
    ("expert_commentary", r"\b(?:invited )?editorial\b|\bexpert (?:commentary|forum)\b|\b(?:perspective|viewpoint)\b|\b(?:debate|controversy)\b|专家解读|专家述评|专家论坛|观点|争鸣文章"),
)
SURGERY_CONTENT = ("surgical_technique", "video_article", "technical_note", "operative_tips", "step_by_step_procedure", "surgical_review", "complication_prevention", "surgical_approach", "anatomy_for_surgery")
GUIDANCE_CONTENT = ("guideline_summary", "guideline_update", "guideline_interpretation", "clinical_practice_recommendation", "expert_commentary_on_guideline", "practice_bulletin_summary")
DYNAMICS_CONTENT = (
    "society_update", "clinical_update", "practice_change", "quality_improvement", "safety_alert", "clinical_service_update",
    "policy_update", "academic_update", "expert_commentary", "professional_review", "guideline_implementation", "substantive_conference_result",
)
#: Content types of a priority article that are labelled as a recent selection.
RECENT_SELECTION_CONTENT = (
    "guideline_summary", "guideline_update", "guideline_interpretation", "clinical_practice_recommendation", "expert_commentary_on_guideline", "practice_bulletin_summary",
    "video_article", "technical_note", "operative_tips", "step_by_step_procedure", "surgical_review", "complication_prevention", "surgical_approach", "anatomy_for_surgery",
    "society_update", "clinical_update", "practice_change", "quality_improvement", "clinical_service_update", "academic_update", "expert_commentary", "professional_review",
    "guideline_implementation", "substantive_conference_result",
)
RECENT_SELECTION_LABEL = "近期精选"

FORMAL_GUIDANCE = r"\b(?:clinical|practice) guideline\b|\bconsensus\b|\bpractice advisory\b|\bcommittee (?:opinion|statement)\b|\bconsult series\b|\bposition statement\b|\bgood practice paper\b|\bscientific impact paper\b|(?:指南|共识|实践公告|委员会意见|委员会声明|立场声明|正式监管建议)"
SURGICAL_METHOD = r"\b(?:surgical technique|video article|technical note|operative technique|step[- ]by[- ]step|instrument(?:ation)?|navigation)\b|(?:手术技术|术式|操作步骤|技术方法|手术器械|手术导航)"
SURGICAL_TOPIC = r"\b(?:laparoscop|hysteroscop|robotic|vnotes|single[- ]port|fertility[- ]sparing|fetal surgery|cerclage|cesarean|caesarean|placenta accreta|gynecologic oncology surgery)\w*\b|(?:腹腔镜|宫腔镜|机器人手术|单孔手术|保留生育功能手术|胎儿手术|宫颈环扎|高危剖宫产|胎盘植入|妇科肿瘤手术)"
DYNAMICS = r"\b(?:society news|clinical service|regulatory update|guideline implementation|patient safety alert|training standard|quality improvement|clinical practice update|professional policy)\b|(?:学会新闻|临床服务|监管更新|指南实施|患者安全提醒|培训规范|质量改进|临床实践更新|妇幼政策|行业标准|母婴安全|助产服务规范|辅助生殖管理|学术活动总结)"
ORDINARY_RESEARCH = r"\b(?:original article|research article|randomi[sz]ed(?: controlled)? trial|clinical trial|cohort study|case-control study|cross-sectional study|retrospective study|prospective study|diagnostic study|validation study|basic research|animal study|cell study|in[- ]vitro|organoid study|case report|case series|study protocol|protocol|systematic review|scoping review|umbrella review|network meta[- ]analysis|meta[- ]analysis)\b|(?:原著|论著|随机对照|临床试验|队列研究|病例对照研究|横断面研究|回顾性研究|前瞻性研究|诊断研究|验证研究|基础研究|动物研究|细胞研究|体外研究|类器官|病例报告|病例系列|研究方案|系统综述|范围综述|伞状综述|荟萃分析|Meta分析)"
PODCAST_PROFESSIONAL = r"\b(?:clinical practice|patient safety|quality improvement|professional policy|guideline implementation|committee|expert(?:s)?|recommend(?:ation|ed)|consensus|maternal|obstetric|gyn(?:ae)?colog|reproductive health|fertility|pregnancy)\b"
PODCAST_PROMOTION = r"\b(?:register|registration|agenda|schedule|join us|webinar|podcast episode|now available|listen now|congress|sponsor|donat|fundrais|appointed|appointment|election|vacancy)\b"
RESEARCH_NEWS = r"\b(?:design helps|helps fight|researchers?\s+(?:find|found|show|showed|report|reported)|study\s+(?:finds?|found|shows?|showed|reports?)|can (?:also )?affect\s+(?:the\s+)?(?:brains?|brain development|fetal development))\b"
RESEARCH_WORD = r"\b(?:research|study|animal|cell(?:ular)?|in[- ]vitro|mechanism|mice|mouse|rat)\b"
TECHNIQUE_LABEL = r"\b(?:video article|technical note|surgical technique)\b"
TECHNIQUE_TITLE = r"^\s*(?:video article|technical note|surgical technique)\b"
GUIDANCE_WORDS = r"\b(?:guideline|committee opinion|practice committee)\b"
VIDEO_TITLE = r"\b(?:video|webinar|podcast|recording)\b"

#: Ids of sources with rules of their own, by the rule.
PODCAST_SOURCES = ("figo-podcast",)
MIXED_FEED_SOURCES = ("medical-xpress-obgyn", "medpage-today-headlines")
DUAL_KEYWORD_SOURCES = ("medpage-today-headlines",)
GUIDANCE_WORD_SOURCES = ("pubmed-asrm-guidance",)
SHARED_QUOTA_SOURCES = ("figo-podcast", "figo-society-pubmed")
SHARED_QUOTA = 8
REVIEW_LIMITS = {"figo-podcast": 4, "figo-society-pubmed": 4, "medpage-today-headlines": 2, "medical-xpress-obgyn": 4}
REVIEW_LIMIT, REVIEW_GROUP_LIMIT, REVIEW_TOTAL = 8, 4, 60
FILL_LIMITS = {"figo-podcast": 3, "figo-society-pubmed": 3, "medpage-today-headlines": 1, "medical-xpress-obgyn": 3}

#: Hours: category -> (priority, supplemental).
WINDOWS = {"tech": (30 * 24, 180 * 24), "finance": (14 * 24, 90 * 24), "politics": (7 * 24, 30 * 24)}
#: Reject reason -> counter.
COUNTERS = {
    "invalid_item": "invalid_item", "promotional": "promotional", "source_excluded": "source_excluded", "not_obgyn": "not_obgyn", "outside_time_window": "outside_time_window",
    "missing_excerpt": "missing_content", "duplicate": "duplicate", "ordinary_research_article": "unsupported_content_type", "unsupported_content_type": "unsupported_content_type",
}
CLASS_VALUE = {"official_authority": 40, "academic_journal": 30, "professional_vertical": 20}
CLASS_VALUE_ELSE = 10

INCLUDE_KEYWORDS = (
    "obstetrics", "obstetric", "gynecology", "gynaecology", "ob/gyn", "pregnancy", "maternal", "fetal", "foetal", "placenta", "preeclampsia", "pre-eclampsia",
    "postpartum", "cesarean", "caesarean", "childbirth", "infertility", "fertility", "reproductive medicine", "ivf", "embryo", "oocyte", "ovarian",
    "cervical", "endometrial", "uterine", "vulvar", "vaginal", "pelvic floor", "endometriosis", "adenomyosis", "fibroid", "gynecologic oncology",
    "gynaecological oncology", "hysteroscopy", "laparoscopy", "robotic surgery", "vnotes", "maternal-fetal medicine", "妇产科", "妇幼", "妇科", "产科", "妊娠",
    "孕产妇", "胎儿", "胎盘", "分娩", "生殖医学", "辅助生殖", "不孕", "宫颈", "卵巢", "子宫内膜", "妇科肿瘤", "腹腔镜", "宫腔镜", "机器人手术", "盆底", "子宫内膜异位症",
)
EXCLUDE_KEYWORDS = (
    "career", "job opening", "membership renewal", "fundraising", "sponsor", "advertisement", "commercial promotion", "patient testimonial",
    "医院宣传", "科室宣传", "医美", "商业广告", "招聘", "会员续费", "纯活动报名", "无专业内容的会议宣传",
)

EVIDENCE = (
    (1.0, r"systematic review|meta-analysis"),
    (0.95, r"randomi[sz]ed controlled trial"),
    (0.85, r"clinical trial"),
    (0.75, r"prospective.*cohort|cohort.*prospective"),
    (0.7, r"diagnostic|validation study"),
    (0.65, r"cohort|case-control|cross-sectional"),
    (0.55, r"retrospective"),
    (0.35, r"feasibility|case series"),
    (0.2, r"case report"),
    (0.1, r"editorial|comment|protocol"),
)
EVIDENCE_ELSE = 0.4
ACTIONABILITY = (
    (0.25, r"animal model|mouse|mice|murine|rat\b|in vitro|cell line|organoid"),
    (0.5, r"feasibility|robotic|laparoscop|hysteroscop|device|technical validation|surgical technique"),
    (1.0, r"randomi[sz]ed|clinical trial|intervention|treatment|diagnos|screening|patient outcome|mortality|morbidity"),
    (0.75, r"cohort|case-control|cross-sectional|observational|population-based|registry|human"),
)
ACTIONABILITY_ELSE = 0.4
RECENCY = ((2, 1.0), (4, 0.75), (7, 0.5))
NON_RESEARCH = r"practice guideline|guideline|consensus|retracted publication|retraction|correction|erratum|news|protocol"

ERROR_KINDS = (
    ("timeout", r"timeout|timed out|etimedout"),
    ("quota", r"(rate.?limit|usage.?limit|quota|429|too many requests|credit.?balance|insufficient.?balance)"),
    ("auth", r"(401|403|unauthorized|invalid.?api.?key|authentication|forbidden)"),
)
DIGEST_SECTIONS = (("tech", 4), ("finance", 4), ("politics", 10))
DIGEST_TOTAL = 15

#: Pages and feeds: what a title or section must and must not be, and the issue's label and date.
NOTICE_ALLOWED = r"指南|共识|核心推荐|临床实践建议|诊疗规范|专家述评|手术技术|手术感染|并发症(?:防控|防治)"
NOTICE_REJECTED = r"会议|征稿|报名|培训|课程|直播|科普|医院|名医|专家风采|商业|推广|研究(?:发现|进展|新闻)|队列|回顾性|病例报告|论著"
SECTION_ALLOWED = r"^(?:述评|专家共识|指南|诊疗规范|指南解读|共识解读|临床实践建议)$"
SECTION_REJECTED = r"论著|普通综述|系统综述|Meta|荟萃分析|病例报告|临床研究|基础研究|回顾性|队列|Original Article"
NUMERIC_DATE = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})"
ISSUE_LABEL = r"(20\d{2}年\s*[,，]?\s*第\d+卷\s*[,，]?\s*第\d+期)"
ISSUE_DATE = r"刊出日期[：:]\s*(20\d{2}-\d{1,2}-\d{1,2})"
FEED_GUIDELINE = r"guideline|consensus|recommendation|position statement"
FEED_SURGERY = r"video article|surgical technique|laparoscop|hysteroscop|robotic|vnotes"
CHALLENGE = ("just a moment", "cf-chl")
OFF_TOPIC = (
    r"(足浴|按摩|捏\s*jio|相亲|对象|男友|女友|分手|婆|岳|家暴|出轨|彩礼|9\.9\s*元|抽奖|薅羊毛|代理\s*IP|住宅\s*IP|跨境\s*(卖家|IP|电商)|辣椒\s*HTTP|买房|买车|装修|房贷|养老|退休|结婚|生娃|带娃|养娃|减肥|健身|"
    r"租房|搬家|签证|移民|岛主|离职|裸辞|老赖|存款|新人报道|无聊|发小|废了|工资|加班吐槽|找工作|失业|找对象)"
)
SPORTS = (
    r"\b(World\s*Cup|Olympics?|UEFA|FIFA|NBA|NFL|NHL|MLB|ATP|WTA|Premier\s*League|Bundesliga|La\s*Liga|Serie\s*A|Champions\s*League|Eurovision|Wimbledon|Grand\s*Slam|F1|Formula\s*1|Ronaldo|Messi|Mbappe|Beckham|"
    r"Lukaku|Mitoma|sportsman|footballer|squad)\b|世界杯|奥运|残奥|冬奥|欧冠|英超|西甲|意甲|德甲|网球|足球|篮球|高尔夫|棒球|板球|橄榄球"
)
#: Publication type -> content type, category; types that exclude a paper.
PUBLICATION_ROUTES = {
    "editorial": ("expert_commentary", "politics"), "commentary": ("expert_commentary", "politics"), "perspective": ("expert_commentary", "politics"), "viewpoint": ("expert_commentary", "politics"),
    "narrative review": ("professional_review", "politics"), "clinical review": ("professional_review", "politics"),
    "video article": ("video_article", "finance"), "surgical technique": ("surgical_technique", "finance"), "technical note": ("technical_note", "finance"),
}
PUBLICATION_EXCLUDED = r"original|research|randomi[sz]ed|clinical trial|cohort|case-control|cross-sectional|systematic|meta-analysis|case report|protocol"
INSTITUTION_JOURNAL, INSTITUTION_ISSN = "Int J Gynaecol Obstet", "1879-3479"
INSTITUTION_TITLE = r"\bFIGO(?:\s+(?:committee|working\s+group|task\s+force|panel))?\s+(?:guidelines?|guidance|recommendations?|consensus|statement|best\s+practice(?:\s+advice|\s+recommendations?)?)\b"
INSTITUTION_EXCLUDED = r"original|research|randomi[sz]ed|clinical\s+trial|cohort|case[- ]control|cross[- ]sectional|systematic|meta[- ]analysis|case\s+report|protocol|letter|comment|response"
INSTITUTION_AUTHOR = r"\bFIGO\b|International Federation of Gynecology and Obstetrics"
INSTITUTION_ABSTRACT = r"\b(?:FIGO|International Federation of Gynecology and Obstetrics)\b[\s\S]{0,120}\b(?:committee|working\s+group|task\s+force|panel|consortium|guideline\s+development|consensus\s+group)\b"
SOCIETY_FORMAL = r"guideline|guidance|recommendation|consensus|position|statement|best\s+practice"
SOCIETY_EXCLUDED = r"original|randomi[sz]ed|clinical\s+trial|cohort|case[- ]control|systematic|meta[- ]analysis|case\s+report|protocol|letter|comment|response|controversy|editorial|narrative\s+review|research\s+article|original\s+article"
SOCIETY_TERMS = r"expert\s+opinion|call\s+to\s+action|committee|perspective|clinical\s+implementation|safety|quality|policy"
SOCIETY_AFFILIATION = r"(?:FIGO|International Federation of Gynecology and Obstetrics)\b.*(?:committee|working\s+group|federation|organization|society|task\s+force|division|department)"
SOCIETY_ABSTRACT = r"FIGO[\s\S]{0,120}(?:committee|working\s+group|division|department|task\s+force)"
#: Sources whose feeds have a limit of their own, and one that is never read.
FEED_LIMITS = {"medical-xpress-obgyn": 8, "medpage-today-headlines": 8, "figo-podcast": 8, "figo-society-pubmed": 8}
NEVER_READ = ("figo-news",)

#: Markets: groups in order with their labels, the watchlist (symbol, name, English name, group), labels and tones.
ASSET_GROUPS = (("macro", "宏观信号", "Macro"), ("us-equity", "美股 / ETF", "US Stocks / ETF"), ("crypto", "加密货币", "Crypto"), ("china-equity", "中概 / 港股", "China / HK"), ("commodity-fx", "商品 / 外汇", "Commodities / FX"))
WATCHLIST = (
    ("SPY", "S&P 500 ETF", None, "us-equity"), ("QQQ", "Nasdaq 100 ETF", None, "us-equity"), ("AAPL", "Apple", None, "us-equity"), ("MSFT", "Microsoft", None, "us-equity"),
    ("NVDA", "Nvidia", None, "us-equity"), ("GOOGL", "Alphabet", None, "us-equity"), ("TSLA", "Tesla", None, "us-equity"), ("META", "Meta", None, "us-equity"),
    ("BTC-USD", "Bitcoin", None, "crypto"), ("ETH-USD", "Ethereum", None, "crypto"), ("SOL-USD", "Solana", None, "crypto"),
    ("BABA", "阿里巴巴 (BABA)", "Alibaba (BABA)", "china-equity"), ("PDD", "拼多多 (PDD)", "Pinduoduo (PDD)", "china-equity"), ("JD", "京东 (JD)", "JD.com (JD)", "china-equity"), ("0700.HK", "腾讯控股 (0700.HK)", "Tencent (0700.HK)", "china-equity"),
    ("GC=F", "黄金期货", "Gold Futures", "commodity-fx"), ("CL=F", "WTI 原油期货", "WTI Crude Futures", "commodity-fx"), ("USDCNY=X", "美元 / 人民币", "USD / CNY", "commodity-fx"),
    ("^VIX", "VIX 恐慌指数", "VIX (Volatility)", "macro"), ("^TNX", "10Y 美债收益率 (%)", "10Y Treasury Yield (%)", "macro"), ("DX-Y.NYB", "美元指数 DXY", "DXY (US Dollar Index)", "macro"),
)
FEAR_GREED_LABELS = {"Extreme Fear": "极度恐慌", "Fear": "恐慌", "Neutral": "中性", "Greed": "贪婪", "Extreme Greed": "极度贪婪"}
FEAR_GREED_TONES = ((24.0, "fear-extreme"), (44.0, "fear"), (55.0, "neutral"), (74.0, "greed"))
SIGNAL_TONES = {
    "golden-cross": "bull", "macd-bull-cross": "bull", "above-sma50-sma200": "bull", "near-52w-high": "bull",
    "death-cross": "bear", "macd-bear-cross": "bear", "below-sma50-sma200": "bear", "near-52w-low": "bear", "rsi-overbought": "caution", "rsi-oversold": "caution",
}
STANCES = (("bull", r"多|涨|上行|bull"), ("bear", r"空|跌|下行|bear"))
#: Model edges: least lengths of a commentary, what a summary says where the abstract doesn't, an empty report's text.
COMMENTARY = {"overview": 100, "picks": 2, "rationale": 20, "attempts": 3}
COMMENTARY_CAVEAT = "以上内容基于公开行情数据的技术指标计算与文本摘要，不构成任何投资建议。过去走势不代表未来表现，市场风险自负。"
NOT_REPORTED = {"zh": "摘要未报告", "en": "Not reported in the abstract"}
EMPTY_REPORT = {"zh": "过去24小时暂无符合质量要求的重要更新。", "en": "No important update met the quality threshold in the past 24 hours."}
SUMMARY_FIELDS = ("title_zh", "research_question", "study_design", "population_and_sample", "methods", "key_results", "limitations", "clinical_interpretation")
#: Enrichers: name -> (name of the title in the payload, further fields, name of the excerpt, its length).
ENRICHERS = {"trending": ("repo", (), "description", 200), "finance": ("title", ("source",), "excerpt", 280), "viral": ("title", ("author",), "previewText", 280), "papers": ("title", (), "excerpt", 300)}
CATEGORY_LIMITS = {"tech": 25, "finance": 20, "politics": 15}
#: Detail pages: sources that are looked up, and what isn't.
DETAIL_SOURCES = ("acog-news", "obgy-cn", "smfm-publications", "cogonline-clinical-guidance", "obgyncn-professional-content")
DETAIL_EXCLUDED = (
    r"\b(?:original|research) article\b|\b(?:systematic|scoping|umbrella) review\b|\bmeta[- ]analysis\b|\bcase (?:report|series)\b|\bprotocol\b|\b(?:randomi[sz]ed|clinical trial|cohort|case-control|cross-sectional)\b",
    r"原著|论著|系统综述|范围综述|伞状综述|荟萃分析|病例报告|研究方案",
)
#: A command line's categories: name -> (category, subcategory) of sources.
REQUESTED = {"guidelines": ("tech", "guidelines"), "surgery": ("finance", "surgery"), "international_obgyn": ("politics", "international-obgyn"), "china_obgyn": ("politics", "china-obgyn")}

#: Pages: classes of boxes that hold a link, of parts that aren't content, and where dates, abstracts and types lie.
LINK_BOXES = ("card", "listing-item", "content-item", "news-listing-item", "views-row", "list-item")
NO_CONTENT_TAGS, NO_CONTENT_CLASSES = ("nav", "aside", "footer", "header", "script", "style"), ("cookie", "related", "recommend")
DATED_CLASSES, DATED_PART = ("article-meta", "news-date"), "publish"
LABELLED_DATE = r"(?:news releases?|published|publication date|发布日期|发布时间)\s*(?:\||:)?\s*([A-Z][a-z]{2,8})\.?\s+(\d{1,2}),?\s+(20\d{2})"
TYPE_DATE = r"\s*\|\s*(?:[A-Z][a-z]{2,8})\.?\s+\d{1,2},?\s+20\d{2}\s*$"
META_DATES = (("property", ("article:published_time",)), ("name", ("date",)), ("name", ("DC.date", "dc.date")), ("name", ("citation_publication_date",)), ("name", ("citation_date",)))
META_EXCERPTS = (("name", "description"), ("property", "og:description"), ("name", "twitter:description"), ("name", "citation_abstract"))
META_TYPES = (("name", "citation_article_type"), ("name", "prism.section"))
EXCERPT_CLASSES, EXCERPT_PARTS = ("abstract", "summary", "lead", "standfirst", "articleBody"), ("abstract", "summary", "lead")
TYPE_CLASSES = ("breadcrumb", "category", "article-category")
ISSUE_DATE_CLASSES, ARTICLE_CLASSES, SECTION_CLASSES = ("issue-date", "publish-date"), ("article-item", "list-item"), ("section", "column", "article-type")

"""Word lists, codes, weights and patterns that results depend on."""

# Job feed: what is accepted.
COMPANY_TYPES = ["央企", "国企"]
JOB_TYPES = ["校招", "实习"]
MAJOR_CODE = "^[A-Za-z0-9][A-Za-z0-9_-]{1,31}$"

# Text of a major requirement that fits a category code.
MAJOR_TEXT = {
    "0809": "计算机|软件|人工智能|数据科学|大数据|网络工程|信息安全|物联网|数字媒体",
    "0807": "电子信息|通信工程|电子科学|微电子",
    "0806": "电气工程|智能电网|电力系统",
    "0808": "自动化|机器人工程|控制工程",
    "0201": "经济学|经济统计|国民经济|资源与环境经济",
    "0203": "金融|保险|投资学",
    "1202": "工商管理|市场营销|会计|财务管理|人力资源|审计",
    "0301": "法学|法律|知识产权",
    "0501": "汉语言|中文|中国语言文学|秘书学",
}
MAJOR_TEXT_OPEN = "不限专业|专业不限|不限|理工科|工科类"

# Degrees, from low to high, and the words for them.
DEGREES = ["secondary", "vocational", "associate", "bachelor", "master", "doctorate"]
DEGREE_WORDS = {
    "高中": "secondary",
    "中专": "secondary",
    "高职": "vocational",
    "专科": "associate",
    "大专": "associate",
    "本科": "bachelor",
    "大学本科": "bachelor",
    "学士": "bachelor",
    "硕士": "master",
    "硕士研究生": "master",
    "博士": "doctorate",
    "博士研究生": "doctorate",
}
DEGREE_SEEN = [("doctorate", "博士"), ("master", "硕士|研究生"), ("bachelor", "本科|学士"), ("associate", "专科|大专"), ("vocational", "高职"), ("secondary", "高中|中专")]

# Category code prefixes and majors that a matcher knows.
CODE_MAJOR = {
    "0201": "经济学类",
    "0203": "金融学类",
    "0301": "法学类",
    "0501": "中国语言文学类",
    "0806": "电气类",
    "0807": "电子信息类",
    "0808": "自动化类",
    "0809": "计算机类",
    "1202": "工商管理类",
}
MAJOR_ALIAS = {
    "计算机": "计算机类",
    "计算机类": "计算机类",
    "计算机科学与技术": "计算机科学与技术",
    "软件工程": "软件工程",
    "网络工程": "网络工程",
    "信息安全": "信息安全",
    "物联网工程": "物联网工程",
    "数据科学与大数据技术": "数据科学与大数据技术",
    "人工智能": "人工智能",
    "电子信息类": "电子信息类",
    "电子信息工程": "电子信息工程",
    "通信工程": "通信工程",
    "电气类": "电气类",
    "电气工程及其自动化": "电气工程及其自动化",
    "自动化类": "自动化类",
    "自动化": "自动化",
    "经济学类": "经济学类",
    "金融学类": "金融学类",
    "工商管理类": "工商管理类",
    "法学类": "法学类",
    "中国语言文学类": "中国语言文学类",
}
FAMILIES = {
    "计算机类": ["计算机科学与技术", "软件工程", "网络工程", "信息安全", "物联网工程", "数据科学与大数据技术", "人工智能", "数字媒体技术"],
    "电子信息类": ["电子信息工程", "通信工程", "电子科学与技术", "微电子科学与工程"],
    "电气类": ["电气工程及其自动化", "智能电网信息工程", "电气工程与智能控制"],
    "自动化类": ["自动化", "机器人工程", "轨道交通信号与控制"],
    "经济学类": ["经济学", "经济统计学", "国民经济管理", "资源与环境经济学"],
    "金融学类": ["金融学", "金融工程", "保险学", "投资学"],
    "工商管理类": ["工商管理", "市场营销", "会计学", "财务管理", "人力资源管理", "审计学"],
    "法学类": ["法学", "知识产权"],
    "中国语言文学类": ["汉语言文学", "汉语言", "秘书学"],
}
RELATED = [("计算机类", "电子信息类"), ("电子信息类", "自动化类"), ("电气类", "自动化类"), ("经济学类", "金融学类"), ("金融学类", "工商管理类")]

# A profile's major: category code for the job list.
INFER_CODE = [
    ("计算机|软件|人工智能|数据科学|网络工程|信息安全", "0809"),
    ("电子信息|通信工程|微电子", "0807"),
    ("电气工程|智能电网", "0806"),
    ("自动化|机器人工程", "0808"),
    ("经济学|经济统计", "0201"),
    ("金融|投资|保险", "0203"),
    ("工商管理|会计|财务管理|人力资源|审计", "1202"),
    ("法学|法律|知识产权", "0301"),
    ("汉语言|中文|秘书学", "0501"),
]
KEYWORDS_OF = ("酒店管理|旅游管理|旅游服务|会展经济|文旅", ["酒店管理", "旅游管理", "酒店运营", "文旅运营", "旅游运营", "客户服务", "宾客服务", "会务", "接待", "商业运营"])

# Preliminary major gate: (profile's major, code, words in the requirement).
GATE_FAMILIES = [
    ("电气|电力系统|智能电网", "0806", "电气|电力|智能电网"),
    ("自动化|控制工程|机器人工程", "0808", "自动化|控制|机器人工程"),
    ("计算机|软件|人工智能|数据科学|网络工程|信息安全", "0809", "计算机|软件|人工智能|数据|网络|信息安全"),
    ("电子信息|通信|微电子", "0807", "电子信息|通信|微电子"),
    ("金融|保险|投资", "0203", "金融|保险|投资"),
    ("经济学|经济统计", "0201", "经济|统计"),
    ("工商管理|市场营销|会计|财务|人力资源|审计", "1202", "工商管理|市场营销|会计|财务|人力资源|审计"),
    ("酒店管理|旅游管理|文旅|会展", "1209", "酒店|旅游|文旅|会展|管理类"),
    ("法学|法律|知识产权", "0301", "法学|法律|知识产权"),
    ("汉语言|中文|秘书", "0501", "汉语言|中文|秘书"),
]

# Capabilities: key, weight in readiness, hours when missing.
CAPABILITIES = [("resume", 18, 8), ("application", 14, 6), ("interview", 16, 12), ("project_evidence", 18, 16), ("internship", 24, 80), ("competition", 10, 20)]

# Market report.
CATEGORIES = [
    ("技术研发", "算法|软件|开发|工程师|研发|技术|数据|人工智能|机器人|测试|运维"),
    ("财务金融", "财务|会计|审计|金融|投资|证券|风控"),
    ("综合管理", "综合|行政|人力|党务|文秘|办公室|管理培训|管培"),
    ("运营服务", "运营|客服|客户服务|酒店|接待|物业|会务|服务岗"),
    ("市场销售", "市场|销售|商务|业务代表|客户经理|营销"),
]
OTHER_CATEGORY, UNKNOWN_REGION = "其他岗位", "地域待确认"
SECTORS = [
    ("tobacco", "烟草|卷烟|中烟"),
    ("power-grid", "电网|电力|供电|发电|电气|核电"),
    ("energy-chemical", "能源|石油|石化|煤炭|矿业|燃气|新能源|化工"),
    ("finance", "银行|保险|证券|金融|信托|基金|资产管理"),
    ("communications-technology", "通信|电信|联通|移动|铁塔|电子科技|数字科技"),
    ("transport-logistics", "铁路|轨道|机场|航空|港口|交通|航运|物流|公交"),
    ("defense-manufacturing", "航天|航空工业|兵器|船舶|军工|装备制造|重工"),
    ("construction-infrastructure", "建筑|建设|中建|中铁|中交|工程局|设计院|基建"),
    ("culture-tourism-service", "酒店|文旅|旅游|景区|宾馆|会展|接待|客户服务|物业|商业运营"),
]
OTHER_SECTOR = "state-owned-other"
DIRECTION_SETS = [("hotel", "酒店管理|旅游管理|旅游服务|会展经济|文旅"), ("electrical", "电气|电力|自动化|电机")]
DIRECTIONS = {
    "hotel": [
        ("hospitality-cultural-tourism", "酒店|文旅|旅游|游乐|乐园|冰雪|水上乐园|预订|经营员"),
        ("customer-service-reception", "客户服务|客服|接待|前台|会务|宾客|形象岗|服务专员"),
        ("commercial-operation-planning", "商业运营|运营|活动|策划|招商|投资|营销|业务代表|产品规划|新媒体|文化传播|外联"),
        ("comprehensive-support", "综合|行政|办公室|助理|文秘"),
    ],
    "electrical": [
        ("power-grid-operation", "电网|供电|输电|变电|配电|继电保护|调度|电力系统"),
        ("power-generation-energy", "发电|火电|水电|核电|风电|光伏|储能|新能源|能源"),
        ("electrical-engineering", "电气|机电|设备|维修|检修|工程|项目|设计|施工|产品服务"),
        ("automation-research", "自动化|控制|仿真|研发|试验|测试|软件|数字化|技术"),
    ],
    "general": [
        ("technology-research", "算法|软件|开发|工程师|研发|技术|数据|人工智能|机器人|测试|运维"),
        ("operations-service", "运营|客服|客户服务|服务|接待|物业|会务"),
        ("market-business", "市场|销售|商务|业务|客户经理|营销|策划"),
        ("finance-risk", "财务|会计|审计|金融|投资|证券|风控"),
        ("comprehensive-management", "综合|行政|人力|党务|文秘|办公室|管理培训|管培"),
    ],
}
DIRECTION_LABELS = {
    "hospitality-cultural-tourism": "酒店与文旅运营",
    "customer-service-reception": "客户服务与接待",
    "commercial-operation-planning": "商业运营与活动策划",
    "comprehensive-support": "综合管理与职能支持",
    "power-grid-operation": "电网运行与调度",
    "power-generation-energy": "发电与新能源",
    "electrical-engineering": "电气设计与工程实施",
    "automation-research": "自动化研发与试验",
    "technology-research": "技术研发与数字化",
    "operations-service": "运营与客户服务",
    "market-business": "市场与商务拓展",
    "finance-risk": "财务金融与风控",
    "comprehensive-management": "综合管理与职能支持",
}
SIGNALS = {
    "intensity": [("值班或倒班", "倒班|轮班|夜班|值班|备班|抢修|应急响应"), ("出差或驻场", "出差|驻场|驻外|项目现场|施工现场"), ("野外或高空作业", "野外|高空|井下|海上作业")],
    "development": [("培训或导师", "导师制|导师|培训体系|入职培训|培养计划|人才培养"), ("轮岗培养", "轮岗|轮训"), ("晋升或专业序列", "晋升|职级|技术序列|专业序列|管理序列")],
    "benefit": [
        ("六险二金", "六险二金"),
        ("五险一金", "五险一金"),
        ("企业年金", "企业年金"),
        ("补充医疗", "补充医疗"),
        ("住房或宿舍", "住房补贴|住房公积金|人才公寓|员工宿舍|提供住宿"),
        ("餐饮或交通补贴", "餐补|工作餐|交通补贴|通勤班车"),
        ("带薪休假", "带薪年假|带薪休假"),
    ],
}
DEGREE_SCORE = {"secondary": 30, "vocational": 45, "associate": 50, "bachelor": 72, "master": 88, "doctorate": 100, "unknown": 50}
READINESS_SCORE = {"missing": 35, "developing": 65, "ready": 92}

# Pages and documents.
TRACKING_KEYS = ["from", "spm", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
UNSUPPORTED_SUFFIXES = [
    ".7z", ".avi", ".bmp", ".doc", ".docm", ".docx", ".dps", ".et", ".flv", ".gif", ".gz", ".jpeg", ".jpg", ".m4a", ".mkv", ".mov", ".mp3", ".mp4",
    ".png", ".ppt", ".pptm", ".pptx", ".rar", ".tar", ".tif", ".tiff", ".wav", ".webm", ".webp", ".wps", ".xls", ".xlsm", ".xlsx", ".zip",
]
INDEX_FILE = "(?i)^index(?:_[0-9]+)*(?:\\.s?html?)?$"
INDEX_TITLE = "(?i)^index(?:_[0-9]+)+(?:\\.s?html?)?$"
GENERIC_TITLES = ["人事招聘", "招聘信息", "招聘公告列表", "招聘信息列表"]
PUBLISHER_SUFFIX = "[－—-]\\s*(?:国务院国有资产监督管理委员会|中国就业网).*$"
GOVERNED_STATUSES = ["review_pending", "superseded"]

# Facts in announcements.
#: Unicode's white space, for a class of a pattern.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE = "[^。！？；;\\n]{1,220}[。！？；;]?"
SENTENCE_LENGTH, SENTENCE_ENDS, SENTENCE_BREAK = 220, list("。！？；;\n"), "(?<=[。！？；;\\n])"
FULL_DATE = "(20\\d{2})\\s*[年./-]\\s*(1[0-2]|0?[1-9])\\s*[月./-]\\s*(3[01]|[12]\\d|0?[1-9])\\s*日?"
MONTH_DAY = "(1[0-2]|0?[1-9])\\s*月\\s*(3[01]|[12]\\d|0?[1-9])\\s*日"
TIME_AFTER = "\\s*([01]?\\d|2[0-3])(?:[:：]([0-5]\\d)|时([0-5]\\d)?分?)"
DEADLINE_CONTEXT = "截止|报名(?:时间|日期|期限)|网申(?:时间|日期|期限)|申请(?:时间|日期|期限)|投递(?:时间|日期|期限)"
SINGLE_DAY_CONTEXT = "截止|(?:报名|网申|申请|投递)日期|期限"
RANGE = "至|到|—|–|~|～"
DEGREE_CONTEXT = "学历|学位|应聘资格|应聘要求|应聘条件|招聘条件|招聘要求|任职要求|报名条件"
DEGREE_FACTS = [("专科", "大专|专科"), ("本科", "本科"), ("硕士", "硕士|(?<!博士)(?<!硕士)研究生及以上"), ("博士", "博士")]
GRADUATION_CONTEXT = "应届|毕业|校园招聘|校招"
GRADUATION_YEAR = "(20\\d{2})(?:\\s*[-—–至到]\\s*(20\\d{2}))?\\s*届"
LIMITS = ["每人[^。；;\\n]{0,40}?(?:可|限)[^。；;\\n]{0,20}?投递\\s*(\\d+)\\s*个", "每人[^。；;\\n]{0,40}?仅有\\s*(\\d+)\\s*次投递机会", "每人[^。；;\\n]{0,40}?最多[^。；;\\n]{0,20}?投递\\s*(\\d+)\\s*个"]
AGE = "(?:1[6-9]|[2-6]\\d|70)"
AGE_CUE = "年龄"
AGE_LABEL = "([㐀-鿿（）()、及]{0,24}?)"
AGE_PREFIX = AGE_LABEL + "年龄(?:要求)?\\s*[:：]?\\s*(?:一般)?\\s*(不超过|不高于|不得超过|不能超过|不满|未满|上限(?:为)?|可?放宽(?:至|到))\\s*(" + AGE + ")\\s*周?岁"
AGE_SUFFIX = AGE_LABEL + "年龄(?:要求)?\\s*[:：]?\\s*(?:一般)?\\s*(?:须|应|应当)?\\s*(?:为|在)?\\s*(" + AGE + ")\\s*周?岁(?:及以下|以下|以内)"
AGE_RANGE = "年龄(?:要求)?\\s*[:：]?\\s*(?:须|应|应当)?\\s*(?:为|在)?\\s*" + AGE + "\\s*周?岁(?:及)?以上[^。；;\\n]{0,20}?(" + AGE + ")\\s*周?岁(?:及以下|以下|以内)"
LOCATION_LABEL = "(?:岗位所在地|工作地点|工作城市|岗位地点|招聘地点|工作区域|工作地)\\s*(?:[:：]|为|包括|包含|覆盖)\\s*([^。！？\\n]{1,220})"
LOCATION_STOP = "[,，、；;]?\\s*(?:学历|学位|专业|年龄|工作经验|岗位职责|招聘对象|福利待遇|薪酬福利|任职资格|资格条件|报名方式|投递方式)\\s*[:：].*$"
ADMIN_SUFFIX = "壮族自治区|回族自治区|维吾尔自治区|自治区|特别行政区|省"
NUMBER = "([1-9]\\d{0,5}|[一二三四五六七八九十百千万两〇零]{1,10})"
HEADCOUNT_CUE = "[0-9一二三四五六七八九十百千万两〇零]\\s*[人名个]"
HEADCOUNTS = [
    "(?:招聘计划人数|招聘人数|招录人数|招聘名额|招录名额)\\s*(?:[:：]|为|共计|共|合计)?\\s*" + NUMBER + "\\s*(?:人|名|个)",
    "(?:招聘|招录)计划\\s*(?:[:：]|为|共计|共|合计)?\\s*" + NUMBER + "\\s*(?:人|名|个)",
    "(?:(?:本次|此次|本批次)\\s*(?:计划|拟)?|(?:计划|拟)|(?:面向社会)?公开)\\s*(?:面向社会)?\\s*(?:公开|校园|社会)?\\s*(?:招聘|招录)\\s*(?:工作人员|员工|专业人才|人才|高校毕业生|应届毕业生)?\\s*(?:共计|共|合计)?\\s*" + NUMBER + "\\s*(?:人|名)",
]
AUDIENCE_CONTEXT = "招聘对象|招聘范围|招聘人群|应聘对象|招录对象|面向|可报名|可以报名|均可报名|社会公开招聘|校园招聘|校招|社会招聘|社招"
UNEMPLOYED = "(?:未落实工作单位|未就业|离校未就业|择业期内)[^。！？；;\\n]{0,24}毕业生|毕业生[^。！？；;\\n]{0,24}(?:未落实工作单位|未就业)"
OVERSEAS = "留学回国人员|留学人员|国(?:[（(]境[）)])?外高校毕业生|境外高校毕业生"
CURRENT, COMBINED, PREVIOUS = "(?:高校)?应届(?:高校)?毕业生", "应往届(?:高校)?毕业生", "(?<!应)往届(?:高校)?毕业生"
GENERAL = "(?:20\\d{2}届(?:高校)?|高校)毕业生"
BOTH_SYSTEMS = "系统内外人员|系统内\\s*[、和及与/]\\s*系统外人员|系统内\\s*[、/]\\s*外人员"
RECRUITMENT_CONTEXT = "招聘|招录|报名|网申|投递|岗位|应聘"
LIFECYCLE = {
    "withdrawn": "撤回|撤销|取消(?:本次|本批次|全部|整体)?(?:公开)?招聘|终止(?:本次|本批次|全部|整体)?(?:公开)?招聘"
    "|决定(?![^。；;\\n]{0,16}(?:是否|不予|不再|暂不|不取消))[^。；;\\n]{0,80}?(?:取消|核减|调减)[^。；;\\n]{0,40}?(?:岗位|招聘计划|招聘人数)"
    "|现予以[^。；;\\n]{0,40}?(?:取消|核减|调减)[^。；;\\n]{0,40}?(?:岗位|招聘计划|招聘人数)"
    "|现将[^。；;：:\\n]{0,24}?(?:取消|核减|调减)[^。；;\\n]{0,40}?(?:岗位|招聘计划|招聘人数)"
    "|(?:取消|核减|调减)\\s*\\d+\\s*(?:个|名)?\\s*(?:招聘)?(?:岗位|计划|人数)"
    "|(?:招聘岗位|岗位情况|岗位调整情况|调整情况|备注)\\s*[：:]?\\s*(?:取消|核减|调减|减少)[^。；;\\n]{0,40}?(?:岗位|招聘计划|招聘人数|招聘名额)",
    "resumed": "恢复(?:本次|本批次)?(?:20\\d{2}年)?(?:公开)?(?:招聘|报名|网申|投递)(?:工作|报名)?|(?:重新启动|重启)[^。；;\\n]{0,20}?(?:招聘|报名|网申|投递)",
    "paused": "(?:暂停|暂缓)[^。；;\\n]{0,24}?(?:招聘|报名|网申|投递)",
    "delayed": "延期|延长[^。；;\\n]{0,40}?(?:报名|网申|投递)(?:时间|日期|期限)?|(?:报名|网申|投递)(?:时间|日期|期限)?[^。；;\\n]{0,12}?延长|截止时间调整",
    "corrected": "更正公告|补充公告|修订公告|招聘信息更正",
}
PARTIAL_TITLE = "(?:取消|核减|调减|减少)[^。；;\\n]{0,24}?(?:岗位|招聘计划|招聘人数|招聘名额)|(?:岗位|招聘计划|招聘人数|招聘名额)[^。；;\\n]{0,24}?(?:取消|核减|调减|减少)"
NEGATED_WITHDRAWAL = "(?:不予|不再|暂不|不)取消"
APPLIED_CORRECTION = "(?:现|特)?(?:对|将)?[^。；;\\n]{0,30}?原公告[^。；;\\n]{0,30}?(?:作出|进行|予以)?(?:更正|修订|调整)|(?:更正|修订|调整)(?:内容)?如下|(?:相关|其他)?事项?以本(?:公告|通知)为准"
PARTIAL_SCOPE = "部分(?:招聘)?岗位|个别(?:招聘)?岗位|(?:取消|核减|调减)[^。；;\\n]{0,20}(?:岗位|招聘人数|招聘计划)(?:数|人数)?|岗位[^。；;\\n]{0,18}(?:取消|核减|调减)"
WHOLE_SCOPE = "(?:终止|取消|撤回|撤销)(?:本次|本批次|全部|整体)[^。；;\\n]{0,18}(?:公开)?招聘(?:工作|公告|计划)|(?:本次|本批次|全部|整体)[^。；;\\n]{0,18}(?:公开)?招聘(?:工作|公告|计划)[^。；;\\n]{0,8}(?:终止|取消|撤回|撤销)"
RESUME_SIGNALS = [
    "招聘[^。；;\\n]{0,50}?(?:\\d+|[一二三四五六七八九十]+)\\s*名|招聘岗位|招聘人数",
    "(?:招聘|报考|应聘|任职)条件",
    "报名(?:人员|材料|时间|方式|网址|邮箱)",
    "资格审查[^。；;\\n]{0,80}?(?:考试|面试)|考试(?:分为|时间|方式)|体检[^。；;\\n]{0,40}?考察",
]
RELATION_GENERIC = [
    "招聘信息更正", "招聘公告", "公开招聘", "社会招聘", "校园招聘", "正式启动", "截止时间", "报名时间", "关于", "公告", "通知", "更正", "补充", "修订", "撤回", "撤销", "取消", "终止", "暂停", "延期", "延长", "调整",
    "招聘", "报名", "投递", "启动", "恢复", "暂缓", "重新启动", "重启",
]
COMPANY_SUFFIX = "(?:集团股份有限公司|股份有限公司|有限责任公司|集团有限公司|集团公司|有限公司|总公司|集团|公司)$"
CONTROLLED_ENTITIES = [(["中国石油", "中石油", "中国石油天然气", "中石油天然气"], "(?:中国石油(?!化工)|中石油(?!化工))"), (["中国石化", "中石化", "中国石油化工", "中石油化工"], "(?:中国石油化工|中石油化工|中国石化|中石化)")]

# Strategy tasks: day of the week and minutes by capability, and what a target asks for: capability, shareable, priority.
TASK_DAYS = {"target_research": 2, "resume": 3, "project_evidence": 3, "application": 4, "academic": 4, "qualification": 4, "interview": 5, "internship": 6, "competition": 6}
TASK_MINUTES = {"target_research": 60, "resume": 120, "project_evidence": 150, "application": 90, "academic": 180, "qualification": 180, "interview": 120, "internship": 180, "competition": 180}
TARGET_NEEDS = [("resume", True, "high"), ("project_evidence", True, "high"), ("application", False, "high"), ("interview", False, "medium")]

# Answers: citation markers and deadline wording.
MARKERS = [("\\[资料(\\d+)(?:[：:][^\\]\\r\\n]{1,120})\\]", "[资料$1]"), ("（资料(\\d+)）", "[资料$1]"), ("根据资料(\\d+)(?=[，,:：])", "根据[资料$1]"), ("资料(\\d+)(?=(?:显示|指出|说明|提到))", "[资料$1]")]
_DAY = "(\\d{4})年(\\d{1,2})月(\\d{1,2})日(?:\\s*([0-2]?\\d)[:：时]([0-5]\\d)?)?"
EVIDENCE_DEADLINES = [
    "(?:报名|投递)[^。；\\n]{0,24}?(?:截止(?:时间|日期)?|截至)[：:\\s]*" + _DAY,
    "(?:报名|投递)[^。；\\n]{0,40}?" + _DAY + "[^。；\\n]{0,16}?截止",
    "(?:报名|投递)(?:时间|日期)?[^。；\\n]{0,16}?(\\d{4})年\\d{1,2}月\\d{1,2}日\\s*(?:至|—|-)\\s*(\\d{1,2})月(\\d{1,2})日(?:\\s*([0-2]?\\d)[:：时]([0-5]\\d)?)?",
    "(?:报名|投递)(?:时间|日期)?[^。；\\n]{0,16}?(?:即日起)?\\s*至\\s*" + _DAY,
]

# Handed-over snapshots: keys that none may hold, and labels of tiers, degrees, features and products.
FORBIDDEN_KEYS = [
    "idCard", "phone", "email", "wechat", "avatar", "resumeUrl", "resumeFileName", "resumeParsedData",
    "pushEmail", "orderNo", "amount", "paymentMethod", "sourceOrderId", "internalUserId", "openId",
]
HANDOFF_TIERS = [("985|211", "985 / 211"), ("双一流", "双一流"), ("海外|境外", "海外院校"), ("高职|专科", "高职高专")]
HANDOFF_DEGREES = [
    ("博士", "doctorate"), ("硕士|研究生", "master"), ("本科|学士", "bachelor"),
    ("大专|专科|高职", "associate"), ("中专|职高|技校", "vocational"), ("高中", "secondary"),
]
FEATURE_CATEGORIES = [
    ("(?i)resume|简历", "resume"), ("(?i)interview|面试", "interview"),
    ("(?i)application|apply|matching|match|job_push|投递|网申|岗位匹配|岗位推送", "application"),
]
PRODUCT_CATEGORIES = [("resume", "简历"), ("application", "网申|投递|岗位推送|岗位匹配"), ("interview", "面试")]

# Market report: actions in order, what fills them up, and rows of the qualification matrix.
REPORT_ACTIONS = [
    ("resume", "完成岗位化简历", 8), ("internship", "补充实习证据", 80), ("project_evidence", "整理项目结果证据", 16),
    ("application", "准备网申材料包", 6), ("interview", "开始目标化面试训练", 12), ("competition", "整理竞赛与荣誉证据", 20),
]
FALLBACK_ACTIONS = [("verification", "核验本批次官方公告", 2, "high"), ("target_research", "建立目标企业清单", 3, "medium")]
LEVEL_TEXTS = [("missing", "尚未开始", "high"), ("developing", "已有基础", "medium"), ("ready", "可直接使用", "low")]
DEGREE_TEXTS = {"secondary": "高中/中专", "vocational": "高职", "associate": "专科", "bachelor": "本科", "master": "硕士", "doctorate": "博士", "unknown": "待补充"}
NAMED_DEGREES = "博士|硕士|本科|大专"
MATRIX_ROWS = ["resume", "internship", "project_evidence", "application", "interview", "competition"]

# More facts in announcements.
GRADUATION_DATE_CONTEXT = "毕业证(?:书)?(?:时间|日期)?|毕业时间|毕业日期|取得(?:毕业证(?:书)?|学位证(?:书)?|学历学位证书|证书)|学历(?:学位)?认证|学位认证|留服认证|留学服务中心认证"
CERTIFICATION = "学历(?:学位)?认证|学位认证|留服认证|留学服务中心认证"
GRADUATION_WORDS = "毕业证(?:书)?(?:时间|日期)?|毕业时间|毕业日期"
DIPLOMA_WORDS = "取得(?:毕业证(?:书)?|学位证(?:书)?|学历学位证书|证书)"
GRADUATION_CLAUSE = "[,，]|(?=并(?:须|应)?(?:于|在)?\\s*20\\d{2}\\s*[年./-])"
GRADUATION_SCOPES = [("国(?:\\(境\\))?内外|境内外|国内外", "境内外"), ("国(?:\\(境\\))?外|境外|国外|留学", "境外"), ("国(?:\\(境\\))?内|境内|国内", "境内")]
ASSESSMENT_CUE = "时间|日期|日程|安排|定于|初定|暂定|拟于|计划于|预计|举行|组织"
ASSESSMENT_EXCLUSION = "(?i)(?:大学)?英语(?:考试)?[四六]级|CET\\s*[-－]?\\s*[46]|职业资格|执业资格|资格证|考试成绩(?:查询|公布)|准考证|缴费"
ASSESSMENT_EXPLICIT = "招聘笔试|初选考试|统一笔试|招聘考试"
EXPERIENCE_NUMBER = "([1-9]|[12]\\d|30|[一二三四五六七八九十两]{1,3})"
EXPERIENCE_CUE = EXPERIENCE_NUMBER + "\\s*年"
EXPERIENCE_WORD = "工作|从业|任职|经验|经历|年限|满|不少于|至少|不低于"
EXPERIENCE_GROUPED = "(博士(?:研究生)?|硕士(?:研究生)?|(?:大学)?本科|大专|专科)[^。；;\\n、，]{0,18}?(?:工作|从业|任职|经验|经历|年限|满|不少于|至少|不低于)[^。；;\\n、，]{0,8}?" + EXPERIENCE_NUMBER + "\\s*年"
EXPERIENCE_GENERIC = [
    "(?:相关)?(?:工作|从业|任职)(?:经验|经历|年限)?[^。；;\\n、，]{0,8}?(?:满|不少于|至少|不低于|达到|需|须|应有|具有)\\s*" + EXPERIENCE_NUMBER + "\\s*年",
    "(?:相关)?(?:工作|从业|任职)(?:经验|经历|年限)?[^。；;\\n、，]{0,8}?" + EXPERIENCE_NUMBER + "\\s*年(?:及以上|以上)",
    "(?:具有|具备|拥有)\\s*" + EXPERIENCE_NUMBER + "\\s*年(?:及以上|以上)?[^。；;\\n、，]{0,12}?(?:相关)?(?:工作|从业|任职)(?:经验|经历)?",
    EXPERIENCE_NUMBER + "\\s*年(?:及以上|以上)[^。；;\\n、，]{0,12}?(?:相关)?(?:工作|从业|任职)(?:经验|经历)?",
]
LANGUAGE_WORD = "(?i)英语|CET"
LANGUAGE_LEVEL = "(?i)([^。！？；;\\n，、]{0,42})((?:大学)?英语(?:考试)?[四六]级|CET\\s*[-－]?\\s*[46])([^。！？；;\\n，、]{0,42})"
LANGUAGE_CUE = "要求|须|应|通过|合格|水平|成绩|分数|不少于|不低于|达到|及以上|以上"
MAJOR_LABELS = ["需求学科", "招聘专业", "需求专业", "急需紧缺专业", "专业要求", "所学专业", "专业范围", "专业类别", "学科专业"]
MAJOR_LABELED = "(急需紧缺专业|需求学科|招聘专业|需求专业|专业要求|所学专业|专业范围|专业类别|学科专业)\\s*(?:[:：]|为|包括|含|涵盖|如下[:：]?)\\s*([^。！？\\n]{1,320})"
MAJOR_GENERIC = "((?:所学)?专业)\\s*(?:须|应|必须|仅|只)?\\s*(?:为|包括|含|涵盖|限于)\\s*([^。！？\\n]{1,320})"
MAJOR_CATEGORY = "([㐀-鿿A-Za-z0-9（）()·+\\-]{1,20}类)\\s*[:：]\\s*([^。！？；;\\n]{2,240}?(?:相关)?专业)"
MAJOR_STOP = "[,，、；;]?\\s*(?:学历|学位|年龄|工作经验|工作地点|任职资格|资格条件|其他条件|户籍|政治面貌|证书|报名方式|投递方式)\\s*[:：][\\s\\S]*$"
CHANNEL_CONTEXT = (
    "(?:简历)?投递(?:入口|网址|网站|地址|邮箱|方式)?|网申(?:入口|网址|网站|地址|方式)?|报名(?:入口|网址|网站|地址|邮箱|方式)|申请(?:入口|网址|网站|地址|方式)"
    "|(?:校园)?招聘(?:官网|网站|门户)|(?:简历|材料)[^。！？；;\\n]{0,20}?(?:发送|投递|提交)"
)
EMAIL = "(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}(?![A-Z0-9.-])"
URL = "(?i)(?<![@A-Z0-9.-])(?:(?:https?://)|(?:www\\.))?(?:[A-Z0-9-]+\\.)+[A-Z]{2,}(?::\\d{2,5})?(?:[/?#][^\\s<>{}\\[\\]（）()，。；;、“”‘’\"']*)?"
IGNORED_PARAMETERS = ["spm", "from"]

# Retrieval payloads: where lists and fields may stand, in order.
SOURCE_LISTS = [
    "results", "results.results", "results.records", "results.items", "results.chunks", "records", "records.results", "records.records", "records.items", "records.chunks",
    "items", "items.results", "items.records", "items.items", "items.chunks", "data", "data.results", "data.records", "data.items", "data.chunks", "chunks", "chunks.results", "chunks.records", "chunks.items", "chunks.chunks",
]
SOURCE_IDS = ["id", "segment.id", "document.id", "segment.document.id"]
SOURCE_TITLES = ["title", "name", "document_name", "documentName", "document.title", "document.name", "segment.document.title", "segment.document.name"]
SOURCE_TEXTS = ["snippet", "content", "text", "segment.content"]
SOURCE_URLS = [
    "url", "source_url", "sourceUrl", "metadata.url", "metadata.source_url", "metadata.sourceUrl", "segment.url", "segment.source_url", "segment.metadata.url", "segment.metadata.source_url",
    "document.url", "document.source_url", "document.metadata.url", "document.metadata.source_url", "segment.document.url", "segment.document.source_url", "segment.document.metadata.url", "segment.document.metadata.source_url",
]
SOURCE_DATES = [
    "publishedAt", "published_at", "date", "metadata.publishedAt", "metadata.published_at", "metadata.published_date", "metadata.date", "segment.publishedAt", "segment.published_at", "segment.metadata.publishedAt", "segment.metadata.published_at",
    "document.publishedAt", "document.published_at", "document.metadata.publishedAt", "document.metadata.published_at", "segment.document.publishedAt", "segment.document.published_at", "segment.document.metadata.publishedAt", "segment.document.metadata.published_at", "segment.document.created_at",
]
# What a query may ask for, and the words that tell it.
EVIDENCE_FACETS = [
    ("招聘对象|面向|毕业生|哪一届|年级|届别|应届", ["招聘对象", "面向对象", "主要面向", "未落实工作单位", "留学回国人员", "高校毕业生", "应届毕业生", "毕业生"]),
    ("学历|学位", ["应聘基本条件", "应聘要求", "全日制硕士研究生及以上学历", "博士、硕士、本科应届毕业生", "本科", "硕士", "博士", "专科", "大专", "学历"]),
    ("年龄|年龄上限|年龄要求|多少岁|几岁", ["年龄要求", "博士研究生年龄", "硕士研究生年龄", "本科及职业学院毕业生年龄", "不超过35岁", "不超过30岁", "不超过26岁"]),
    ("(?i)外语|英语水平|英语要求|雅思|托福", ["外语水平要求", "雅思", "托福"]),
    ("(?i)四级|CET[\\s-]?4", ["大学英语四级", "四级考试", "CET4", "CET-4"]),
    ("(?i)六级|CET[\\s-]?6", ["大学英语六级", "六级考试", "CET6", "CET-6"]),
    ("年级|届别|哪一届|应届", ["在校大学生", "应届毕业生", "届", "毕业"]),
    ("截止|截至|还可以报名|报名时间|投递时间|何时", ["报名截止时间", "报名时间", "投递截止时间", "截止时间", "即日起至", "截至", "报名结束"]),
    ("入口|在哪里报名|怎么报名|报名方式|投递方式|官网|网站|邮箱", ["报名方式", "简历投递", "投递简历", "投递入口", "招聘官网", "招聘门户", "电子邮件", "邮箱", "二维码", "www.", "http://", "https://"]),
    ("几个岗位|多少岗位|岗位数|每人.{0,8}(?:报|投)|限报|投递次数|申报岗位", ["仅限申报", "只能报考", "限报", "1个岗位", "一个岗位", "一次投递", "1次投递"]),
    ("招聘批次|如何分批|分几批|批次", ["招聘批次", "四批次招聘", "国调网调提前批", "第一批", "第二批", "第三批"]),
    ("单位志愿|二级单位|三级单位|四级单位|(?:几个|多少).{0,6}(?:招聘)?单位|最多.{0,8}(?:招聘)?单位|应聘.{0,6}(?:招聘)?单位", ["二级单位志愿", "不超过3个", "三级单位", "四级单位", "可选择2个", "最多可应聘2家招聘单位", "应聘2家招聘单位"]),
    ("招聘单位|单位分布|下属单位|所属单位|成员企业", ["招聘单位地图分布", "单位分布", "招聘单位", "所属单位", "成员企业"]),
    ("笔试时间|考试时间|考试安排|何时笔试|什么时候笔试", ["统一笔试时间", "笔试时间", "组织招聘笔试", "统一笔试"]),
    ("报名|申请|投递", ["报名方式", "简历投递", "投递简历", "投递要求", "招聘官网", "报名", "二维码", "阅读原文", "投递", "截止时间", "www."]),
    ("交通|食宿|后勤", ["往返交通", "全程食宿", "统一安排", "后勤"]),
    ("福利|薪酬|待遇|补贴|保障", ["薪酬福利", "福利待遇", "福利保障", "北京户口", "六险两金", "七险两金", "人才公寓", "员工公寓", "员工食堂", "各类补贴", "补充医疗", "企业年金"]),
    ("岗位类别|岗位类型|岗位种类|有哪些岗位", ["岗位类别", "招聘岗位", "技术类", "市场类", "综合类"]),
    ("毕业时间|毕业日期|境内外|留学生|学历认证", ["毕业时间", "毕业证时间", "境内高校", "国（境）内高校", "国（境）外高校", "学历认证"]),
    ("技术方向|研发方向", ["引才方向", "技术方向", "研发工程师"]),
    ("专业|学科", ["需求学科", "招聘专业", "需求专业", "急需紧缺专业", "专业要求"]),
    ("城市|地点|地区", ["工作地点", "工作城市", "城市", "地点"]),
]

# What a text must hold for a facet's patterns to find anything: they are tried on no other text.
FACET_GATES = {
    "application_limits": "每人", "age_requirements": "年龄.*岁", "assessment_dates": "笔试|面试|测评|考试", "language_requirements": "英语|(?i:CET)", "major_requirements": "专业|学科",
    "experience_requirements": "(?:工作|从业|任职|经验|经历|年限|满|不少于|至少|不低于)[^。；;、，]{0,20}年|年[^。；;、，]{0,20}(?:工作|从业|任职)", "application_channels": "(?i)[A-Z0-9.-]\\.[A-Z]{2}",
}
LIFECYCLE_WORDS = {
    "withdrawn": "撤回|撤销|取消|终止|核减|调减|减少", "resumed": "恢复|重新启动|重启", "paused": "暂停|暂缓", "delayed": "延期|延长|截止时间调整", "corrected": "更正|修订|调整|补充公告|为准",
}

# Facets that a search request can ask for: what asks, and the labels that answer.
QUERY_FACETS = [
    ("招聘对象|面向|毕业生|哪一届|年级|届别|应届", ["招聘对象", "面向对象", "高校毕业生", "应届毕业生", "毕业生"]),
    ("学历|学位|本科|硕士|博士|专科|大专", ["学历要求", "最低学历", "本科", "硕士", "博士", "专科", "大专"]),
    ("年龄|年龄上限|年龄要求|多少岁|几岁", ["年龄要求", "博士研究生年龄", "硕士研究生年龄", "本科及职业学院毕业生年龄", "不超过35岁", "不超过30岁", "不超过26岁"]),
    ("(?i)外语|英语水平|英语要求|雅思|托福", ["外语水平要求", "雅思", "托福"]),
    ("(?i)四级|CET[\\s-]?4", ["大学英语四级", "四级考试", "CET4", "CET-4"]),
    ("(?i)六级|CET[\\s-]?6", ["大学英语六级", "六级考试", "CET6", "CET-6"]),
    ("专业|学科|技术方向|研发方向", ["需求学科", "招聘专业", "需求专业", "急需紧缺专业", "专业要求", "技术方向", "引才方向"]),
    ("岗位类别|岗位类型|岗位种类|有哪些岗位", ["岗位类别", "招聘岗位", "技术类", "市场类", "综合类"]),
    ("工作城市|工作地点|城市|地点|地区", ["工作地点", "工作城市", "招聘地区", "城市", "地点"]),
    ("报名|申请|投递|简历|网申|入口|官网|网站|邮箱", ["简历投递", "投递简历", "投递方式", "报名方式", "投递入口", "报名入口", "招聘官网", "www."]),
    ("薪酬|福利|待遇|补贴|户口|公寓", ["薪酬福利", "福利待遇", "福利保障", "六险两金", "七险两金", "人才补贴", "人才公寓", "员工公寓"]),
    ("毕业时间|毕业日期|境内外|留学生|学历认证", ["毕业时间", "毕业证时间", "境内高校", "国（境）内高校", "国（境）外高校", "学历认证"]),
    ("招聘流程|招聘程序|流程|程序|笔试|面试", ["招聘流程", "招聘程序", "笔试", "面试", "资格审查"]),
    ("招聘批次|如何分批|分几批|批次", ["招聘批次", "四批次招聘", "国调网调提前批", "第一批", "第二批", "第三批"]),
    ("单位志愿|二级单位|三级单位|四级单位|(?:几个|多少).{0,6}(?:招聘)?单位|最多.{0,8}(?:招聘)?单位|应聘.{0,6}(?:招聘)?单位", ["二级单位志愿", "不超过3个", "三级单位", "四级单位", "可选择2个", "最多可应聘2家招聘单位", "应聘2家招聘单位"]),
    ("笔试时间|考试时间|考试安排|何时笔试|什么时候笔试", ["统一笔试时间", "笔试时间", "组织招聘笔试", "统一笔试"]),
    ("招聘单位|单位分布|下属单位|所属单位|成员企业", ["招聘单位", "单位分布", "所属单位", "成员企业"]),
    ("交通|食宿|后勤", ["往返交通", "全程食宿", "统一安排", "后勤保障"]),
    ("截止|截至|还可以报名|还能报名", ["报名截止时间", "投递截止时间", "截止时间", "截止日期"]),
    ("几个岗位|报考|投递次数|几个意向|投几个", ["只能报考一个岗位", "1次投递", "一次投递", "1个意向", "投递次数"]),
]

# Excerpts of evidence: labels of sections, of which the first group also begins a sentence, and marks where a page's text ends.
SENTENCE_LABELS = [
    "招聘对象", "面向对象", "报名方式", "报名时间", "简历投递", "投递简历", "投递入口", "招聘官网", "招聘门户", "报名截止时间", "投递截止时间", "往返交通", "全程食宿",
    "薪酬福利", "福利保障", "工作地点", "需求学科", "招聘专业", "需求专业", "急需紧缺专业", "专业要求", "引才方向", "投递要求", "年龄要求", "外语水平要求",
    "大学英语四级", "大学英语六级", "招聘批次", "二级单位志愿", "统一笔试时间", "笔试时间", "组织招聘笔试",
]
STRUCTURAL_LABELS = [*SENTENCE_LABELS, "工作城市", "技术方向"]
PAGE_ENDS = ["（责任编辑", "网站声明", "版权所有："]

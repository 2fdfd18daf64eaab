"""Values that results depend on: vocabularies, limits, patterns and wording.

Everything here is a plain constant. Changing one changes query results.
"""

# --- fixed values: import vocabulary -------------------------------------------------
TRUE_WORDS = ("1", "true", "yes", "是", "开")
FALSE_WORDS = ("0", "false", "no", "否", "关")
GOOD_QUALITY_WORDS = ("good", "ok", "192", "0xc0", "true")
DEFAULT_STATUS = "Good"
DEFAULT_ZONE = "Asia/Shanghai"
RAW_TEXT_LIMIT = 500
STATUS_TEXT_LIMIT = 64
ISSUE_STORE_LIMIT = 10_000
PREVIEW_ROWS = 20
CSV_ENCODINGS = ("utf-8-sig", "gb18030")
CSV_DELIMITERS = ",\t;"
FILE_SUFFIXES = {".csv": "csv", ".xlsx": "xlsx"}
OPEN_BATCH_STATUSES = ("uploaded", "queued", "processing", "completed")

HEADER_ALIASES = {
    "timestamp_column": (
        "timestamp", "source_timestamp", "datetime", "time", "时间", "采集时间", "数据时间",
    ),
    "tag_code_column": ("tag_code", "tag", "point_code", "point", "测点编码", "测点", "变量编码"),
    "value_column": ("value", "numeric_value", "reading", "测量值", "数值", "值"),
    "device_code_column": ("device_code", "device", "设备编码", "设备"),
    "quality_column": ("quality", "status_code", "quality_code", "质量码", "状态码", "质量"),
}
REQUIRED_ALIAS_FIELDS = ("timestamp_column", "tag_code_column", "value_column")

ISSUE_ADVICE = {
    "missing_required": "检查字段映射及必填单元格，补齐后重新导入。",
    "invalid_timestamp": "检查时间列、时区和日期格式，不要使用批次编号代替时间。",
    "invalid_value": "核对测点数据类型及原始单元格，去除非法文本。",
    "out_of_range": "核对单位、测点量程和原始记录；不要为通过校验而直接扩大范围。",
    "unknown_tag": "核对测点编码、所属设备和工厂；确认主数据后再导入。",
    "ambiguous_tag": "补充设备编码以区分同名或同编码测点。",
    "duplicate_in_file": "核对文件内同测点同时间的重复记录和保留规则。",
    "duplicate_existing": "核对已入库记录，避免重复导入；不要直接删除历史数据。",
    "bad_quality": "核对数据源质量码及采集状态；异常质量样本不能视为正常工艺值。",
}
ISSUE_REPORT_COLUMNS = ("行号", "严重级别", "问题类型", "字段", "原始值", "说明")

# --- fixed values: number and time syntax --------------------------------------------
NUMBER_PATTERN = (
    r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
)
NON_FINITE_PATTERN = r"^[+-]?(nan|inf|infinity)$"
CODE_PATTERN = r"^[A-Z0-9][A-Z0-9_-]*$"

# --- fixed values: freshness, limits, retrieval --------------------------------------
STALE_FLOOR_SECONDS = 60
STALE_INTERVALS = 3
FUTURE_TOLERANCE_SECONDS = 5
TREND_MAX_HOURS = 24
HISTORY_MAX_LIMIT = 5_000
RETENTION_MAX_DAYS = 3_650
DEVICE_LIST_LIMIT = 30
TAG_SEARCH_LIMIT = 20
DOCUMENTS_PER_PLANT = 100
CHUNK_STEP = 600
CHUNK_LENGTH = 700
BM25_K1 = 1.2
BM25_B = 0.75
LEXICAL_GATE = 0.12
SEMANTIC_GATE = 0.50
FUSION_OFFSET = 60
CHUNKS_PER_DOCUMENT = 2
EVIDENCE_LIMIT = 5
MAX_VECTOR_SIZE = 4_096
RUN_QUOTA_SECONDS = 60
STOP_TERMS = ("什么", "怎么", "如何", "请问", "一下", "这个", "那个")
TERM_PATTERN = "[a-z0-9_]+|[一-鿿]+"
CJK_PATTERN = "^[一-鿿]"

# --- fixed values: asset and task bounds ---------------------------------------------
SAMPLING_INTERVAL_MS = (100, 86_400_000)
PUBLISHING_INTERVAL_MS = (100, 60_000)
FLUSH_ROWS = (1, 2_000)
FIRST_DELAY_SECONDS = (1, 300)
LAST_DELAY_SECONDS = (1, 900)
NODES_PER_TASK = (1, 200)
TITLE_CHARACTERS = (1, 200)
CONTENT_CHARACTERS = (10, 30_000)
ENDPOINT_SCHEME = "opc.tcp"

# --- fixed values: delivery audit ----------------------------------------------------
DELIVERY_RATIO = (0.95, 1.05)
HEARTBEAT_FLOOR_SECONDS = 15

# --- fixed values: archive rules (code pattern, accepted names, location) ------------
# ``{code}`` stands for the whole code, ``{rest}`` for the code after its prefix,
# ``{kind}`` for the single letter after ``RET_``.
ARCHIVE_RULES = (
    (r"^AI_UI_\d{13}_\d{1,4}$", ("AI界面测试 {code}",), "合成数据测试"),
    (r"^P_E2E_\d{8}$", ("数据治理测试工厂",), "隔离测试环境"),
    (
        r"^PLANT_[A-Z0-9]{8}$",
        ("Synthetic Plant {code}", "Synthetic Plant {code} Updated"),
        "Test Zone",
    ),
    (r"^AI_LIVE_\d{13}$", ("AI真实联调合成工厂 {code}",), "合成验收数据"),
    (
        r"^AI_BUSINESS_\d{13}$",
        ("AI业务验收演示工厂 {rest}",),
        "合成演示，不是生产数据",
    ),
    (r"^RET_[AB]_\d{13}$", ("保留预览测试{kind}",), None),
)

# --- fixed values: question rules ----------------------------------------------------
WINDOW_PATTERN = (
    r"(?:过去|最近|近|前)\s*([0-9]+(?:\.[0-9]+)?|[一二两三四五六七八九十百半]+)"
    r"\s*(小时|分钟|天|日|星期|周|个月|月|年)"
)
TREND_PATTERN = "趋势|变化|均值|平均|最大|最小|统计|极值"
GROUPING_PATTERN = "每(?:个)?(?:小时|天|日|分钟)|逐(?:小时|日)|按(?:小时|天|分钟)"
TASK_SUBJECT = "采集任务"
TASK_EXCLUDED = (
    "如何|怎么|怎样|步骤|假设|假如|如果|能否|能不能|是否可以|"
    "(?:不要|不用|无需|不必|禁止)(?:去|再)?(?:查|查询|读取)|"
    "(?:只|仅)(?:解释|说明|讨论|看)"
)
TASK_NOW = "当前|现在|实际|查询|查一下|列出"
TASK_MEASURE = "几个|多少|数量|总数|共有|状态|是否|运行|停止|连接|丢数"
CHINESE_DIGITS = "一二两三四五六七八九"
CHINESE_DIGIT_VALUES = "1223456789"
HALF = "半"
UNIT_HOURS = {"分钟": 1 / 60, "小时": 1, "天": 24, "日": 24, "周": 168, "星期": 168}
UNSUPPORTED_UNITS = ("个月", "月", "年")

# --- fixed values: answer rules ------------------------------------------------------
CONDITIONAL_PATTERN = (
    r"^(?:可以|能|允许|可继续)(?:[，,。；;：:]|\s)*"
    r"(?:但(?:是)?|不过)(?:[，,]|\s)*(?:需(?:要)?|须|必须|应先|要先|前提)"
)
REFUSAL_PATTERN = (
    r"^(?:抱歉[，,。]?\s*)?(?:"
    r"(?:我|本助手|AI助手)(?:无法|不能|不会)(?:为你|为您|替你|替您)?"
    r"(?:绕过权限|执行(?:修改|删除|写入)|直接(?:修改|删除|写入)|批准旁路)"
    r"|(?:无法|不能|不会)(?:绕过权限|执行(?:修改|删除|写入)|直接(?:修改|删除|写入)))"
)
VERSIONED_IDENTIFIER = r"\b[a-zA-Z][a-zA-Z0-9_-]*[-_]v\d+(?:[._-]\d+)*\b"
OPTIONAL_QUALITY = r"quality_code.{0,15}(?:可选|可不映射|可以不映射)"
WARNING_COUNT = r"[1-9]\d*\s*条(?:坏质量)?警告"
HEDGED_CLAUSE = "不能|不应|不要|不代表|不足以|未必|不一定|无法断言"
PROVENANCE_CLAIM = (
    "(?:所有|全部|全部的|所有的).{0,12}(?:文件|数据).{0,16}(?:均|都|是|为).{0,8}(?:模拟|合成)"
    "|(?:文件|数据).{0,12}(?:均为|都是|全是|一律是).{0,8}(?:模拟|合成)"
    "|(?:平台|其所涉及的).{0,12}数据来源.{0,8}要么"
    "|平台(?:也)?不(?:存储|包含).{0,12}(?:指标|数据|记录)"
)
CLAUSE_BREAK = "[。；\n]"
CANARIES = ("CANARY_73921", "PRIVATE_482")
SNAPSHOT_TITLES = ("acquisition_status", "asset_overview")

# --- fixed values: import messages by broken rule --------------------------------------
ISSUE_MESSAGES = {
    "missing_timestamp": "数据时间不能为空",
    "invalid_timestamp": "时间必须是 ISO 8601 或常见日期时间格式",
    "bad_quality": "质量码不是 Good；保留原始值并标记为非良好数据",
    "missing_required": "测点编码和值均不能为空",
    "unknown_pair": "工厂内不存在该启用设备与测点组合",
    "unknown_tag": "工厂内不存在该启用测点编码",
    "ambiguous_tag": "测点编码不唯一，请指定设备编码",
    "invalid_boolean": "布尔值只能使用 true/false、1/0、是/否或开/关",
    "invalid_integer": "整数测点不能导入小数",
    "not_finite": "数值不能是 NaN 或无穷大",
    "invalid_value": "数值格式无效",
    "out_of_range": "数值超出测点范围",
    "duplicate_in_file": "文件内同一测点和时间戳重复",
    "duplicate_existing": "数据库中已存在同一测点和时间戳的文件数据",
}

# --- fixed values: display wording ---------------------------------------------------
STATE_WORDS = {
    "running": "运行",
    "stopped": "停止",
    "connected": "已连接",
    "connecting": "连接中",
    "reconnecting": "重连中",
    "error": "异常",
}
PHASE_WORDS = ("正常基线", "注入扰动", "恢复观察")
ENABLED_WORDS = ("已启用", "已禁用")
TREND_HEAD_TEXT = "测点 %s（%s）；来源 %s；测点%s。\n请求时间范围：%s 至 %s。\n返回 %s 条；Good数值 %s 条；坏质量 %s 条。\n"
# Sentence of the trend text when only the newest samples were asked for.
TREND_CUT_TEXT = "结果已截断：以下仅为最近至多{limit}条样本的统计，不是整个请求时间范围的统计。\n"
TREND_NUMBERS_TEXT = "均值 %.6f %s；最小值 %.6f %s；最大值 %.6f %s。\n"
TREND_CHANGE_TEXT = "首末差 %.6f %s。\n"
TREND_NO_CHANGE_TEXT = "不足两个有效数值，无法计算首末差。\n"
TREND_TIMES_TEXT = "返回样本首末时间：%s 至 %s。\n"
TREND_NO_NUMBERS_TEXT = "没有有效Good数值样本，不能计算均值或极值，不能解释为零。\n"
TREND_TAIL_TEXT = "数值统计排除坏质量和非数值样本；Good不等于工艺合格，首末差不是趋势斜率，不进行故障根因判断或预测。"
TREND_FILE_TEXT = "file来源为历史文件，不是实时采集。"
TASK_TEXT = "%s：期望%s，记录连接状态%s；心跳 %s，最后样本 %s；接收%s / 写入%s / 丢弃%s / 重复%s / 错误%s / 重连%s。"
DEVICE_TEXT = "%s / %s：%s 个测点。"

# Sizes of the file profile; they bound memory and do not change what is accepted.
DECODE_BLOCK = 1 << 20
SNIFF_BYTES = 64 * 1024

# Import: the reason of a batch whose file lacks mapped columns, and how much of a reason is kept.
MISSING_COLUMNS_TEXT = "映射列不存在："
ERROR_TEXT_LIMIT = 2000

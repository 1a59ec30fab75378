"""Rule packs: keyword lists and thresholds as data.

Operators take a RulePack, so other feeds use their own words. The default pack holds the lists for public notices of
schools' information equipment.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The keyword lists, in their order.

ORG_INCLUDE = [
    "大學", "學院", "科技大學", "技術學院", "專科學校", "專科", "軍官學校", "國防大學", "國防醫學院", "學校", "國民小學", "國民中學", "國小", "國中", "高中",
    "女中", "附中", "高職", "高級中學", "教育局", "教育處", "教育部", "教育署",
]

ORG_EXCLUDE_STRONG = [
    "附設醫院", "附屬醫院", "分院", "診所",
]

ORG_EXCLUDE_WEAK = [
    "醫院",
]

ORG_WHITELIST = [
    "醫學院",
]

PROJECT_CONTEXT = [
    "國民中小學", "中小學", "國民中學", "國民小學", "高級中等學校", "高中", "高職", "校園",
]

STRICT = [
    "校務系統", "校務行政整合平台", "學務系統", "教務系統", "總務系統", "防火牆", "弱點掃描", "滲透測試", "fortigate", "palo alto", "sentinelone",
    "crowdstrike", "tenable", "office 365", "m365", "microsoft 365", "microsoft365", "microsoft 365 edu",
    "microsoft365 edu", "microsoft ees", "microsoft ees 授權", "microsoft ees、ovs-es", "microsoft ees、ove-es", "微軟",
    "微軟授權", "微軟全校授權", "微軟校園授權", "微軟產品全校授權", "微軟m365", "微軟ees", "微軟ees、ovs-es", "微軟ees、ove-es", "windows",
    "office", "azure", "mircrosoft azure", "azure openai", "openai gpt", "windows server", "server cal",
    "power bi", "copilot", "copilot 教育版", "unified support", "備份系統", "備份備援", "veeam", "acronis", "commvault",
    "虛擬化", "vmware", "citrix", "hyper-v", "虛擬桌面", "thin client", "零終端", "gpu 伺服器", "ai伺服器", "ai 伺服器", "ai伺服器叢集",
    "邊緣ai運算", "邊緣 ai 運算", "人工智慧應用", "高階ai運算", "ai運算", "ai運算與儲存", "ai科技教育", "ai智能防護", "ai動捕", "aicg", "rag",
    "知識庫問答", "ocr", "rpa", "學習管理系統", "數位學習平台", "ovs-es", "ovs-es 教育版", "教育版授權", "校園授權", "全校授權", "大量授權", "ca全校授權",
    "ees 授權", "ove-es", "ove-es 授權", "企業 ea", "超融合設備", "超融合平台", "ees", "校園網路",
]

STABLE = [
    "資訊設備", "資訊服務", "資訊安全", "社交安全", "email security", "郵件安全", "防釣魚", "dlp", "電腦", "電腦設備", "筆記型電腦", "平板電腦",
    "ipados", "平板", "周邊設備", "學習載具", "伺服器", "電腦主機", "主機", "mac", "imac", "macbook", "網路設備", "無線網路", "無線網路設備",
    "無線基地台", "基地臺", "wi-fi", "wifi", "aruba", "cisco meraki", "ruckus", "網路建置", "交換器", "路由器", "基地台",
    "access point", "終端運算設備", "負載平衡", "電視牆", "顯示牆", "拼接顯示", "拼接螢幕", "led顯示", "led 顯示", "顯示器", "觸控", "電子白板", "儲存",
    "nas", "儲存系統", "磁碟陣列", "storage", "netapp", "pure storage", "qnap", "nvme", "雲端", "資安", "防毒", "卡巴斯基",
    "kaspersky", "軟體訂閱", "軟體", "授權軟體", "授權租約", "軟體租約", "軟體授權", "軟體維護", "虛擬實境", "vr", "元宇宙", "動捕", "機房", "管理系統",
    "管理平台", "認證系統", "認證伺服器", "維護服務契約書", "資訊系統", "整合系統", "數位整合系統", "智慧教室", "教室設備", "智能學習支援系統", "基礎建設平台", "教學助理",
    "ai助教", "lms", "學習分析", "檔案管理", "文件智慧處理", "文件分類", "文件摘要", "報表智慧產生", "自然語言問問題", "ai 運算", "ai運算", "邊緣ai",
    "邊緣 ai", "高階ai運算", "ai運算與儲存", "ai智能", "ai無線", "ai 無線", "ai智服", "ai智服系統", "ai智能防護", "nvidia", "dgx", "ai影像",
    "ai 影像", "ai影片", "ai 影片", "生成教案", "自動批改", "gpu 運算", "運算平台", "語言學習機", "sanako", "教學數位環境", "顯卡", "顯示卡", "資料庫",
    "資料庫硬體", "oracle", "硬體升級", "adobe", "acrobat", "photoshop", "creative cloud", "substance", "繪圖板", "繪圖機",
    "wacom", "xp-pen", "designjet", "imageprograf",
]

BROAD = [
    "軟體", "雲端", "網路設備", "資訊服務", "機房", "openai", "工作站",
]

SUPPORT_ONLY = [
    "工作站",
]

WORKSTATION_CONTEXT = [
    "ai", "gpu", "人工智慧", "高效能", "運算", "儲存", "虛擬化", "顯示器", "繪圖卡", "顯卡", "顯示卡", "nvidia", "dgx",
]

TEACHING_CONTEXT = [
    "數位", "電腦", "資訊", "語言學習", "sanako", "ai", "智慧", "智能", "多媒體", "元宇宙", "動捕", "虛擬實境", "vr",
]

INTERNAL = [
    "標案投標", "履約", "驗收", "發票對帳", "標案監測",
]

EXCLUDE = [
    "防水", "消防", "水電", "遊具", "實驗耗材", "醫療設備", "飲水機", "窗簾", "節律系統", "心律調節器", "超音波乳化", "超音波掃描", "超音波探頭", "呼吸器",
    "呼吸照護", "麻醉機", "腦波系統", "心電圖", "血壓計", "血糖機", "醫療耗材", "手術器械", "導引鞘", "導管", "抽血站", "檢驗站", "診療服務", "門診服務", "質譜儀",
    "光譜儀", "色譜儀", "顯微鏡", "離心機", "培養箱", "示波器", "電錶", "三用電錶", "函數產生器", "信號產生器", "頻譜分析儀", "認證證書服務", "認證服務", "檢驗服務",
    "交通安全", "交通安全裝備", "溫室氣體盤查", "主導查證員", "查證員", "內部稽核員培訓", "能源管理系統內部稽核", "空調", "冷氣", "冷卻水塔", "冰水主機", "vrv", "傢具",
    "家具", "桌椅", "廁所", "廁所改善", "廁所整修", "整修", "整修工程", "土建", "土木", "土木工程", "建築工程", "校舍工程", "門禁", "門禁管理系統",
]

TAGS = {
    "資安": [
        "資安", "資訊安全", "防火牆", "弱點", "防毒", "零信任", "fortigate", "palo alto", "sentinelone", "crowdstrike", "tenable",
        "email security", "郵件安全", "dlp", "防釣魚", "rms", "ims", "ad 漏洞", "災難復原",
    ],
    "雲端": [
        "雲端", "cloud", "saas", "iaas", "paas", "azure", "mircrosoft azure", "azure openai", "openai gpt", "m365",
        "office 365", "microsoft 365", "microsoft365", "microsoft 365 edu", "microsoft365 edu", "onedrive",
        "teams", "outlook", "vm", "pve", "虛擬化", "vmware", "hyper-v", "citrix", "虛擬桌面",
    ],
    "網路": [
        "網路", "無線", "交換器", "路由器", "wifi", "wi-fi", "ap", "access point", "aruba", "meraki", "ruckus", "基地臺",
        "基地台",
    ],
    "顯示設備": [
        "電視牆", "顯示牆", "拼接顯示", "拼接螢幕", "led顯示", "led 顯示", "顯示器", "電子白板", "觸控",
    ],
    "軟體": [
        "軟體", "授權", "訂閱", "系統", "資訊系統", "整合系統", "copilot", "copilot studio", "copilot 教育版", "openai", "a9 openai",
        "adobe cct", "adobe", "acrobat", "photoshop", "creative cloud", "substance", "github enterprise server",
        "power bi", "m365", "microsoft 365", "microsoft365", "microsoft 365 edu", "microsoft365 edu",
        "microsoft ees", "微軟", "微軟授權", "微軟全校授權", "微軟校園授權", "全校授權", "校園授權", "大量授權", "windows", "office", "azure",
        "mircrosoft azure", "unified support", "windows server", "server cal", "ees", "ove-es", "fabric",
        "m365 cowork", "segma", "向量資料庫", "知識庫問答", "rag", "ocr", "rpa", "lms", "學習管理系統", "數位學習平台", "校務行政整合平台",
        "教學助理", "報表智慧產生", "虛擬人像", "自動化申請表單", "ovs-es", "教育版授權", "ees",
    ],
    "機房": [
        "機房", "server room", "機櫃", "電力", "gpu 伺服器", "server", "伺服器", "dell", "hpe", "lenovo", "jetson agx orin",
        "nvidia", "dgx", "超融合設備", "超融合平台", "工作站", "儲存", "storage", "nas", "netapp", "pure storage", "qnap",
        "veeam", "acronis", "commvault",
    ],
    "電力": [
        "ups", "不斷電", "不斷電系統", "電力", "配電", "電源", "pdu",
    ],
    "整合": [
        "整合", "系統整合", "整合系統", "數位整合系統", "超融合", "超融合設備", "超融合平台",
    ],
    "內部營運": INTERNAL,
}

WORKSTATION, TEACHING_EQUIPMENT, TEACHING_EQUIPMENT_OFFICE = "工作站", "教學設備", "教務處教學設備"
WORKSTATION_TITLES, HIGHER_EDUCATION = ["工作站", "工作站採購"], ["大學", "學院", "專科"]
#: Classes of organisations in the order in which they are tried.
UNIT_TYPES = [
    ("軍校", ["軍官學校", "國防大學", "國防醫學院"]),
    ("專科", ["專科", "技術學院"]),
    ("高中職", ["附中", "附屬中學", "附屬高級中學", "附設高級中學", "附屬國民中學", "高級中學", "高級中等學校", "完全中學"]),
    ("國中小", ["附小", "附屬小學", "附設小學", "附設實驗國民小學", "國民小學", "國民中學", "國民中小學", "中小學", "國小", "國中"]),
    ("大學", ["大學", "學院"]),
    ("高中職", ["高中", "高職"]),
    ("教育局處", ["教育局", "教育處"]),
    ("實驗學校", ["實驗學校"]),
    ("學校", ["學校"]),
]
OTHER_UNIT, HINT, HINT_TAG = "其他", "computer_edu", "電腦"
SOURCE_PRIORITY = {"gov_pcc": 3, "taiwanbuying": 2, "g0v": 1}


@dataclass(frozen=True)
class RulePack:
    """The words and classes that gates, tags and linkage use. Keywords match as substrings."""

    org_include: list[str] = field(default_factory=lambda: ORG_INCLUDE)
    org_exclude_strong: list[str] = field(default_factory=lambda: ORG_EXCLUDE_STRONG)
    org_exclude_weak: list[str] = field(default_factory=lambda: ORG_EXCLUDE_WEAK)
    org_whitelist: list[str] = field(default_factory=lambda: ORG_WHITELIST)
    project_context: list[str] = field(default_factory=lambda: PROJECT_CONTEXT)
    strict: list[str] = field(default_factory=lambda: STRICT)
    stable: list[str] = field(default_factory=lambda: STABLE)
    broad: list[str] = field(default_factory=lambda: BROAD)
    support_only: list[str] = field(default_factory=lambda: SUPPORT_ONLY)
    exclude: list[str] = field(default_factory=lambda: EXCLUDE)
    #: A term that counts only if a context word is there as well.
    conditional: list[tuple[str, list[str]]] = field(default_factory=lambda: [(WORKSTATION, WORKSTATION_CONTEXT), (TEACHING_EQUIPMENT, [*TEACHING_CONTEXT, TEACHING_EQUIPMENT_OFFICE])])
    fallback_titles: list[str] = field(default_factory=lambda: WORKSTATION_TITLES)
    fallback_orgs: list[str] = field(default_factory=lambda: HIGHER_EDUCATION)
    tags: dict[str, list[str]] = field(default_factory=lambda: TAGS)
    unit_types: list[tuple[str, list[str]]] = field(default_factory=lambda: UNIT_TYPES)
    other_unit: str = OTHER_UNIT
    hint: str = HINT
    hint_tag: str = HINT_TAG
    source_priority: dict[str, int] = field(default_factory=lambda: SOURCE_PRIORITY)


DEFAULT = RulePack()

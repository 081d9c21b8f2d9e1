"""Fixed values of the content taxonomy: categories, tags and what speaks for them. All must be as they stand for right results."""

VERSION = "daily-content-v1"
#: Most letters of a title and of its evidence that are read.
TITLE, EVIDENCE = 600, 6000
CATEGORIES = (
    "ai_ml", "cloud_infra", "software_dev", "systems_os", "security_privacy", "data_database", "hardware_chips", "product_business", "org_management",
    "policy_society", "science_research", "general_interest",
)
SUBJECTS = (
    "llm", "ai_agent", "ai_application", "ai_service", "multimodal", "model_training", "robotics", "kubernetes", "serverless", "distributed_systems",
    "sre", "observability", "networking", "python", "rust", "go", "javascript", "java", "cpp", "compiler", "web_dev", "developer_platform", "linux",
    "windows", "apple_platform", "android", "browser", "kernel", "database", "data_engineering", "vector_search", "gpu", "cpu", "semiconductor",
    "gaming_hardware", "edge_device",
)
LENSES = (
    "open_source", "methodology", "research_paper", "formal_verification", "architecture", "engineering_practice", "performance", "reliability",
    "vulnerability", "privacy", "incident_review", "product_release", "business_model", "engineering_management", "regulation", "digital_sovereignty",
    "diy_hardware",
)
#: For each: (pattern, its weight in a title, in the evidence, whether case counts).
CATEGORY_RULES = {
    "security_privacy": (
        (
            r"\bCVE-[0-9]{4}-[0-9]+\b|\bRCE\b|remote code execution|actively exploited|zero[ -]day|sandbox (?:escape|breakout)|安全漏洞|远程代码执行|正在利用|零日漏洞|沙箱逃逸|"
            r"绕过.{0,8}沙箱|沙箱.{0,8}(?:绕过|限制)", 20, 8, False),
        (r"\b(?:vulnerabilit(?:y|ies)|exploit|malware|ransomware|cybersecurity|security advisory|data breach)\b|(?:安全事件|网络安全|恶意软件|勒索软件|数据泄露|隐私风险)", 10, 4, False),
    ),
    "policy_society": (
        (r"\b(?:law|legislation|regulation|regulator|government policy|public policy|sanction|tariff|export control|ban)\b|(?:法律|立法|监管|政府政策|公共政策|制裁|关税|出口管制|禁令)", 15, 6, False),
        (r"\b(?:Pentagon|government corruption|geopolitical|election|digital sovereignty)\b|(?:五角大楼|政府腐败|地缘政治|选举|数字主权)", 10, 4, False),
    ),
    "org_management": (
        (r"engineers?.{0,36}(?:lose touch|deskilling|skill erosion)|(?:工程师|开发者).{0,20}(?:技能退化|失去掌控|脱离系统)", 20, 8, False),
        (
            r"\b(?:engineering management|management|manager|leadership|organization(?:al)?|team culture|hiring|layoffs?|workplace|developer productivity)\b|"
            r"(?:工程管理|组织管理|领导力|团队文化|招聘|裁员|职场|开发者效率)", 12, 5, False),
    ),
    "cloud_infra": (
        (r"\b(?:outages?|downtime|service disruption|incident response|postmortem)\b|(?:服务中断|服务故障|系统故障|同期故障|大面积故障|宕机|事故响应|故障复盘)", 16, 6, False),
        (
            r"\b(?:cloud computing|cloud platform|Amazon Web Services|AWS|Microsoft Azure|Google Cloud|GCP|Kubernetes|K8s|serverless|site reliability engineering|"
            r"SRE)\b|(?:云计算|云平台|云服务|容器编排|无服务器|站点可靠性)", 12, 5, False),
        (r"\b(?:distributed systems?|microservices?|observability|infrastructure|data cent(?:er|re)|git hosting|code hosting)\b|(?:分布式系统|微服务|可观测性|基础设施|数据中心|代码托管)", 10, 4, False),
    ),
    "ai_ml": (
        (
            r"(?<![a-z0-9])(?:AI|LLM|VLM)(?![a-z0-9])|\b(?:artificial intelligence|machine learning|deep learning|large language models?|foundation models?|"
            r"neural networks?|transformers?|diffusion models?|agentic AI|AI agents?)\b|(?<![a-z0-9])GUI agents?(?![a-z0-9])|(?:人工智能|机器学习|深度学习|大语言模型|大模型|基础模型|神经网络|"
            r"扩散模型|生成模型|智能体|机器人|图像生成|图像编辑)", 12, 5, False),
        (r"\b(?:OpenAI|Anthropic|ChatGPT|Claude|Gemini|Grok|Hugging Face)\b|(?:模型训练|模型推理|知识蒸馏|蒸馏|强化学习|预训练|后训练|多模态|具身智能)", 8, 3, False),
    ),
    "data_database": (
        (r"\b(?:database|PostgreSQL|MySQL|SQLite|DuckDB|Redis|ClickHouse|data warehouse|data lake|query engine|vector database)\b|(?:数据库|数据仓库|数据湖|查询引擎|向量数据库)", 12, 5, False),
        (r"\b(?:ETL|data engineering|data pipeline|stream processing|vector search|retrieval augmented generation|RAG)\b|(?:数据工程|数据管道|流处理|向量检索|检索增强生成)", 9, 4, False),
    ),
    "systems_os": (
        (r"\b(?:operating system|Linux kernel|FreeBSD|OpenBSD|macOS|iOS|Android OS|Microsoft Windows|Windows (?:10|11|Server)|device driver)\b|(?:操作系统|系统内核|设备驱动)", 13, 5, False),
        (r"\b(?:Chromium|Chrome|Firefox|WebKit|web browser|browser engine)\b|(?:浏览器|浏览器内核)", 9, 3, False),
    ),
    "hardware_chips": (
        (r"\b(?:GPU|CPU|NPU|TPU|semiconductor|microchip|chiplet|processor|accelerator|RISC-V|gaming PC|keyboard)\b|(?:芯片|半导体|处理器|加速器|显卡|游戏电脑|键盘|硬件)", 13, 5, False),
        (r"\b(?:AMD|NVIDIA|Intel|Arm)\s+(?:GPU|CPU|APU|processor|chip|accelerator|BC-[0-9]+)\b", 10, 4, False),
    ),
    "software_dev": (
        (
            r"\b(?:programming language|software engineering|compiler|interpreter|runtime|developer tools?|SDK|API design|Nitter)\b|(?:编程语言|软件工程|编译器|解释器|运行时|开发工具|"
            r"接口设计)", 12, 5, False),
        (r"\b(?:Git|GitHub|GitLab|Codeberg|rustc|Cargo|Golang|TypeScript|JavaScript|OpenJDK|JVM)\b|(?:代码仓库|源码托管)", 9, 3, False),
        (
            r"\b(?:Python|Rust|Java)\s+(?:[0-9]+(?:\.[0-9]+)*|language|compiler|runtime|package|library|framework)\b|\b(?:written|built|implemented) in (?:Python|"
            r"Rust|Go|Java|C\+\+)\b", 10, 4, False),
    ),
    "product_business": (
        (
            r"\b(?:pricing|subscription|business model|acquisition|revenue|monetization|go-to-market|startup funding|venture funding)\b|(?:定价|订阅|商业模式|收购|营收|商业化|"
            r"市场进入|创业融资|风险融资)", 12, 5, False),
        (r"\b(?:product launch|product strategy|user experience|customer adoption)\b|(?:产品发布|产品策略|用户体验|客户采用)", 7, 3, False),
    ),
    "science_research": (
        (r"\b(?:theorem|formal proof|formalizing|mathematics|physics|chemistry|biology|clinical trial)\b|(?:定理|形式化证明|数学|物理学|化学(?:研究|实验|反应|材料|学科)|生物学|临床试验)", 15, 6, False),
        (r"\b(?:research paper|peer review|scientific study)\b|(?:研究论文|同行评审|科学研究)", 7, 3, False),
    ),
}
TAG_RULES = {
    "llm": (
        (r"(?<![a-z0-9])LLMs?(?![a-z0-9])|\blarge language models?\b|(?:大语言模型|大模型)", 10, 4, False),
    ),
    "ai_agent": (
        (r"\b(?:AI|LLM|autonomous)[ -]?agents?\b|\bagentic\b|(?<![a-z0-9])GUI agents?(?![a-z0-9])|(?:AI智能体|智能体|代理系统)", 10, 4, False),
    ),
    "ai_application": (
        (r"\bAI[- ](?:assisted|powered|enabled|driven)\b|\bAI tools?\b|\bAI (?:handles?|writes?|reviews?|operates?|manages?)\b|(?:AI辅助|AI驱动|AI应用)", 8, 3, False),
    ),
    "ai_service": (
        (r"\b(?:ChatGPT|Claude|Gemini|Grok)\b|(?:AI服务|模型服务)", 8, 3, False),
    ),
    "multimodal": (
        (r"\b(?:multimodal|vision-language|text-to-image|image generation)\b|(?:多模态|视觉语言|文生图|图像生成|图像编辑)", 9, 4, False),
    ),
    "model_training": (
        (r"\b(?:model training|fine-tuning|distillation|reinforcement learning|pretraining|post-training)\b|(?:模型训练|微调|蒸馏|强化学习|预训练|后训练)", 9, 4, False),
    ),
    "robotics": (
        (r"\b(?:robotics?|embodied AI)\b|(?:机器人|具身智能)", 9, 4, False),
    ),
    "kubernetes": (
        (r"\b(?:Kubernetes|K8s)\b", 10, 4, False),
    ),
    "serverless": (
        (r"\bserverless\b|无服务器", 9, 4, False),
    ),
    "distributed_systems": (
        (r"\bdistributed systems?\b|分布式系统", 9, 4, False),
    ),
    "sre": (
        (r"\b(?:SRE|site reliability engineering)\b|站点可靠性", 9, 4, False),
    ),
    "observability": (
        (r"\bobservability\b|可观测性", 9, 4, False),
    ),
    "networking": (
        (r"\b(?:networking|network protocol|TCP|QUIC|DNS|BGP)\b|网络协议", 8, 3, False),
    ),
    "python": (
        (r"\bPython\s+(?:[0-9]+(?:\.[0-9]+)*|language|interpreter|package|library|framework)\b|\b(?:CPython|PyPI)\b|Python语言", 10, 4, False),
    ),
    "rust": (
        (r"\bRust\s+(?:[0-9]+(?:\.[0-9]+)*|language|compiler|crate|library|framework)\b|\b(?:rustc|Cargo)\b|Rust语言", 10, 4, False),
    ),
    "go": (
        (r"\bGolang\b|\bGo (?:programming language|language|compiler|runtime|module|package|toolchain|code)\b|Go语言", 10, 4, False),
    ),
    "javascript": (
        (r"\b(?:JavaScript|TypeScript|Node\.js|Deno|Bun)\b", 10, 4, False),
    ),
    "java": (
        (r"\b(?:OpenJDK|JVM|JDK|Java [0-9]+|Java language)\b|Java语言", 10, 4, False),
    ),
    "cpp": (
        (r"(?<![A-Za-z0-9])(?:C\+\+|C language)(?![A-Za-z0-9])|C语言", 10, 4, False),
    ),
    "compiler": (
        (r"\bcompiler\b|编译器", 8, 3, False),
    ),
    "web_dev": (
        (r"\b(?:web development|web framework|frontend|browser API)\b|Web开发", 8, 3, False),
    ),
    "developer_platform": (
        (r"\b(?:Git|code) hosting\b|\b(?:GitHub|GitLab|Codeberg)\b|(?:代码托管|开发者平台)", 9, 4, False),
    ),
    "linux": (
        (r"\bLinux(?: kernel| distribution| distro| [0-9])?\b", 10, 4, False),
    ),
    "windows": (
        (r"\b(?:Microsoft Windows|Windows (?:10|11|Server|kernel|driver))\b", 10, 4, False),
    ),
    "apple_platform": (
        (r"\b(?:macOS|iOS|iPadOS|visionOS|SwiftUI)\b", 10, 4, False),
    ),
    "android": (
        (r"\bAndroid(?: OS| [0-9]| app| platform)?\b", 10, 4, False),
    ),
    "browser": (
        (r"\b(?:Chromium|Chrome|Firefox|WebKit|web browser|browser engine)\b|浏览器", 10, 4, False),
    ),
    "kernel": (
        (r"\bkernel\b|系统内核", 9, 4, False),
    ),
    "database": (
        (r"\b(?:database|PostgreSQL|MySQL|SQLite|DuckDB|Redis|ClickHouse)\b|数据库", 10, 4, False),
    ),
    "data_engineering": (
        (r"\b(?:ETL|data engineering|data pipeline|stream processing)\b|数据工程|数据管道", 9, 4, False),
    ),
    "vector_search": (
        (r"\b(?:vector search|vector database|RAG)\b|向量检索|向量数据库", 9, 4, False),
    ),
    "gpu": (
        (r"\b(?:GPU|NPU|TPU|graphics processor|AI accelerator)\b|显卡|AI加速器", 10, 4, False),
    ),
    "cpu": (
        (r"\b(?:CPU|central processing unit)\b|中央处理器", 10, 4, False),
    ),
    "semiconductor": (
        (r"\b(?:semiconductor|microchip|chiplet|chip fabrication)\b|芯片|半导体", 9, 4, False),
    ),
    "gaming_hardware": (
        (r"\b(?:gaming PC|gaming hardware)\b|游戏电脑|游戏硬件", 9, 4, False),
    ),
    "edge_device": (
        (r"\b(?:edge device|on-device|embedded device)\b|边缘设备|端侧", 8, 3, False),
    ),
    "open_source": (
        (
            r"\b(?:open[ -]source|source available|MIT licen[cs]e|Apache[- ]2|GPL)\b|\breleas(?:e|es|ed|ing) (?:the )?(?:source code|code and weights|"
            r"model weights)\b|(?:开源|开放.{0,12}(?:代码|源码|模型权重|权重))", 10, 4, False),
    ),
    "methodology": (
        (r"\b(?:methodology|playbook|best practices?|practical guide)\b|(?:方法论|实践指南|最佳实践|经验总结)", 9, 4, False),
    ),
    "research_paper": (
        (r"\b(?:research paper|paper proposes|authors? (?:show|report|find)|peer-reviewed study)\b|(?:研究论文|这项工作|论文提出|作者(?:发现|报告))", 8, 4, False),
    ),
    "formal_verification": (
        (r"\b(?:formal verification|formal proof|formalizing)\b|形式化验证|形式化证明", 10, 4, False),
    ),
    "architecture": (
        (r"\b(?:software|system) architecture\b|架构设计|系统架构", 8, 3, False),
    ),
    "engineering_practice": (
        (r"\b(?:engineering practice|implementation guide|lessons learned)\b|工程实践|实现指南", 8, 3, False),
    ),
    "performance": (
        (r"\b(?:performance optimization|benchmarking|latency|throughput)\b|性能优化|延迟|吞吐量", 8, 3, False),
    ),
    "reliability": (
        (r"\b(?:reliability|resilien(?:ce|t)|fault toleran(?:ce|t))\b|可靠性|韧性|容错", 8, 3, False),
    ),
    "vulnerability": (
        (
            r"\bCVE-[0-9]{4}-[0-9]+\b|\bRCE\b|remote code execution|actively exploited|zero[ -]day|\bvulnerabilit(?:y|ies)\b|安全漏洞|远程代码执行|零日漏洞|绕过.{0,8}沙箱|"
            r"沙箱.{0,8}(?:绕过|限制)", 12, 5, False),
    ),
    "privacy": (
        (r"\bprivacy\b|隐私", 8, 3, False),
    ),
    "incident_review": (
        (r"\b(?:outages?|downtime|incident response|postmortem)\b|(?:服务中断|服务故障|系统故障|同期故障|宕机|事故响应|故障复盘)", 10, 4, False),
    ),
    "product_release": (
        (r"\b(?:launches?|releases?|unveils?)\b|(?:(?:产品|模型|版本|工具|服务).{0,8}(?:发布|推出|上线)|(?:发布|推出|上线).{0,8}(?:产品|模型|版本|工具|服务))", 7, 3, False),
    ),
    "business_model": (
        (r"\b(?:pricing|subscription|business model|monetization)\b|定价|订阅|商业模式|商业化", 9, 4, False),
    ),
    "engineering_management": (
        (r"\b(?:engineering management|developer productivity|team culture|engineers?.{0,30}(?:lose touch|deskilling))\b|(?:工程管理|开发者效率|团队文化|技能退化)", 10, 4, False),
    ),
    "regulation": (
        (r"\b(?:law|regulation|regulator|public policy|export control)\b|法律|监管|公共政策|出口管制", 9, 4, False),
    ),
    "digital_sovereignty": (
        (r"\b(?:digital sovereignty|data sovereignty|never leaves Europe|hosted in Europe|European hosting)\b|数字主权|数据主权|欧洲托管", 10, 4, False),
    ),
    "diy_hardware": (
        (r"\b(?:DIY|homebuilt|self-built)\b|自行组装|DIY硬件", 8, 3, False),
    ),
}

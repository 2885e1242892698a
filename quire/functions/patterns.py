"""Patterns, word lists and thresholds.

The patterns are written in the common subset of Java and RE2 regular expressions, so that the
same text can be used by Spark and by the SQL the results are checked against.
"""

# Unicode white space, as a regular-expression class body and as a trim list.
SPACE = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
HAN = r"\x{4e00}-\x{9fff}"
# Digits of chapter numbers.
NUM = "一二三四五六七八九十百千万0-9"

# Characters that mark a formula.
MATH_CHARS = "∑∫∏√∂∇∞∈∉⊂⊆∪∩∀∃≈≠≤≥±×÷→←⇒⇔θαβγδελμπσφωΔΛΣΦΨΩξζηκντρς"

# Layout thresholds.
HEADER_SHARE = 0.08
FOOTER_SHARE = 0.08
FORMULA_SHARE = 0.05
TITLE_RATIO = 1.15
BOLD_TITLE_RATIO = 1.05
BOLD_TITLE_CHARS = 40
DEFAULT_BODY_SIZE = 12.0

# Chunking, retrieval and report limits.
SCAN_THRESHOLD = 30
PARAGRAPH_LIMIT = 900
WINDOW_SIZE = 600
WINDOW_OVERLAP = 80
RRF_K = 60
TOP_K = 5
MIN_PRIMARY_HITS = 3
QUERY_TOKENS = 8
SNIPPET_CHARS = 400

# Subject terms that stay whole in the index.
SUBJECT_TERMS = [
    "拉格朗日中值定理", "拉格朗日", "中值定理", "罗尔定理", "柯西中值定理",
    "泰勒公式", "泰勒展开", "麦克劳林", "牛顿莱布尼茨", "定积分", "不定积分",
    "微分方程", "偏导数", "全微分", "特征值", "特征向量", "特征方程", "行列式",
    "线性相关", "线性无关", "正交矩阵", "对称矩阵", "伴随矩阵", "逆矩阵",
    "概率分布", "随机变量", "数学期望", "方差", "协方差", "正态分布",
    "泊松分布", "二项分布", "大数定律", "中心极限定理", "傅里叶变换",
    "拉普拉斯变换", "卷积", "梯度下降", "贝叶斯", "极大似然", "熵",
]

# Words that are no concepts.
CONCEPT_STOP_WORDS = [
    "一个", "不同", "影响", "进行", "通过", "可以", "以及", "需要", "问题", "之间",
    "根据", "结果", "方法", "分析", "研究", "理论", "概念", "定义", "变量", "指标",
    "关系", "过程", "发展", "就是", "成为", "作为", "对于", "关于", "其中", "这里",
    "那里", "这些", "那些", "这个", "那个", "主要", "重要", "基本", "一般", "相关",
    "有关", "方面", "内容", "包括", "具有", "没有", "不是", "或者", "但是",
    "因为", "所以", "如果", "那么", "然后", "我们", "他们", "自己", "什么", "怎么",
    "的", "了", "是", "在", "有", "和", "与", "及", "或", "等", "中", "上", "下",
    "第一", "第二", "第三", "之一", "某种", "每个", "按照", "属于", "对应", "唯一",
    "法则", "常数", "是非", "数集", "趋近", "无限",
]

# Prose that runs into a heading; what follows it is cut.
PROSE_TAILS = [
    "组织是人类.*$",
    "随着时代的发展$",
    "从20世纪中叶开始$",
    "自从有文字记载的历史以来$",
    "在两千多年前$",
    "现代政府组织.*$",
    "公共部门需要财政资源.*$",
]

# Paragraph styles that are headings, by level.
HEADING_STYLES = {
    "heading 1": 1, "heading 2": 2, "heading 3": 3, "heading 4": 4, "heading 5": 5,
    "title": 1, "subtitle": 2,
    "大标题": 1, "标题": 1, "章标题": 1, "篇标题": 1,
    "一级标题": 1, "二级标题": 2, "三级标题": 3, "四级标题": 4, "五级标题": 5,
    "小节标题": 2,
}

# Headings. Group 1 is the number, group 2 the title.
# What a chapter, section or subsection line looks like.
CHAPTER = rf"^第[{SPACE}]*([{NUM}]+)[{SPACE}]*[章篇编部][{SPACE}]*(?:[|｜:：][{SPACE}]*)?([^|\n]{{2,40}})"
SECTION = rf"^第[{SPACE}]*([{NUM}]+)[{SPACE}]*节[{SPACE}]*(?:[|｜:：][{SPACE}]*)?([^|\n]{{2,40}})"
# The three-level scan takes a section title as it stands, separator included.
PLAIN_SECTION = rf"^第[{SPACE}]*([{NUM}]+)[{SPACE}]*节[{SPACE}]*([^|\n]{{2,40}})"
DOTTED_2 = rf"^([0-9]{{1,2}}\.[0-9]{{1,2}})[{SPACE}]*([^|\n]{{2,40}})"
DOTTED_3 = rf"^([0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{1,2}})[{SPACE}]*([^|\n]{{2,40}})"
DOT_LEADER = r"[.．·]{4,}"

# Lines that cleaning removes or keeps apart.
PAGE_NUMBER_LINE = rf"^[-–—{SPACE}]*[0-9]{{1,4}}[-–—{SPACE}]*$"
CLOSED_LINE = r"[。；：！？，、.?!;:)\]0-9]$"
TITLE_LINE = rf"^(?:第[{SPACE}]*[一二三四五六七八九十0-9]+[{SPACE}]*[章节篇编部]|[0-9]+(?:\.[0-9]+)*[{SPACE}]|[一二三四五六七八九十]+、)"

# Wording of definitions, theorems and citations.
TERM = rf"([{HAN}A-Za-z][{HAN}A-Za-z0-9·\-()（）]{{1,30}}?)"
DEFINITION_OF_WORDS = "的概念|的定义"
DEFINITION_IS_WORDS = "是指|指的是|称为|叫做|定义为|即为|即|就是|表示"
DEFINITION_OF = TERM + rf"(?:{DEFINITION_OF_WORDS})(?:是|为|：|:)?[{SPACE}]*([^\n]{{2,150}}?)(?:[。；;]|$)"
DEFINITION_IS = TERM + rf"(?:{DEFINITION_IS_WORDS})([^\n]{{2,150}}?)(?:[。；;]|$)"
THEOREM = rf"(?:^|[\n。])[{SPACE}]*(定理|定义|命题|引理|推论|公理|定律|性质|公式)[{SPACE}]*([0-9]+(?:\.[0-9]+)*)?[{SPACE}]*[:：]?[{SPACE}]*([^\n]{{2,150}})"
NAMED_THEOREM = rf"(?:^|[\n。])[{SPACE}]*([{HAN}A-Za-z]{{2,20}}?(?:定理|公式|定律|法则|原理))[{SPACE}]*[:：][{SPACE}]*([^\n]{{2,150}})"
WORD = r"[\p{L}\p{N}]+"
CITATION = r"(?:资料|ref)([0-9]+)"

"""Label names, cue lists, stop headings, aliases, prompts, section grammar.

Everything in this file must equal the published annotation scheme for results to be right.
All operators take these as default arguments, so another language or scheme is a parameter.
"""

# Concept types and assertion labels, in canonical order.
TYPES = ("TRIỆU_CHỨNG", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM", "CHẨN_ĐOÁN", "THUỐC")
ASSERTIONS = ("isNegated", "isFamily", "isHistorical")
DIAGNOSIS, DRUG = "CHẨN_ĐOÁN", "THUỐC"
TYPES_WITH_CANDIDATES = ("CHẨN_ĐOÁN", "THUỐC")
TYPES_WITH_ASSERTIONS = ("CHẨN_ĐOÁN", "THUỐC", "TRIỆU_CHỨNG")

# Assertion cues and self-negating mention prefixes.
NEGATION_CUES = (
    "không có", "không thấy", "không ghi nhận", "chưa ghi nhận", "chưa phát hiện",
    "không còn", "loại trừ", "âm tính", "phủ nhận", "không bị",
)
HISTORICAL_CUES = (
    "tiền sử", "tiền căn", "trước khi nhập viện", "trước nhập viện", "đã được chẩn đoán",
)
FAMILY_CUES = (
    "bố bệnh nhân", "mẹ bệnh nhân", "cha bệnh nhân", "gia đình bệnh nhân",
    "người nhà", "tiền sử gia đình", "bố đẻ", "mẹ đẻ", "anh trai", "chị gái",
)
NEGATED_PREFIXES = ("không", "chưa")

# Document headings that are never concepts.
STOP_HEADINGS = (
    "tiền sử bệnh", "tiền sử bệnh hiện tại", "tiền sử bệnh nội khoa", "tiền sử bệnh lý",
    "tiền sử bệnh nội", "tiền sử phẫu thuật", "tiền sử phẫu thuật / thủ thuật",
    "bệnh sử hiện tại", "diễn biến bệnh",
    "các bệnh lý mạn tính", "các bệnh lý mãn tính", "các bệnh mãn tính",
    "bệnh lý mãn tính", "bệnh lý mạn tính",
    "lý do nhập viện", "lý do vào viện",
    "triệu chứng hiện tại", "các triệu chứng hiện tại", "triệu chứng khi nhập viện",
    "đặc điểm triệu chứng", "thời điểm khởi phát triệu chứng",
    "triệu chứng liên quan", "các triệu chứng liên quan",
    "các sự kiện trước khi nhập viện", "sự kiện trước khi nhập viện",
    "tình trạng ngay trước khi nhập viện", "thuốc trước khi nhập viện",
    "thuốc trước khi nhập viện lần này",
    "các tập tương tự trước đây", "các tập phát bệnh tương tự trước đây",
    "đánh giá tại bệnh viện", "khám tại bệnh viện", "dấu hiệu lâm sàng", "toàn trạng",
    "cận lâm sàng", "kết quả xét nghiệm", "kết quả chẩn đoán hình ảnh",
    "các thủ thuật đã thực hiện", "các phát hiện chẩn đoán khác",
    "điều trị", "điều trị tại bệnh viện", "thuốc điều trị", "thuốc đã dùng",
    "câu hỏi từ người dùng", "câu trả lời của bác sĩ", "trả lời",
    "câu hỏi của người dùng gửi đến hệ thống", "các yếu tố nguy cơ liên quan",
    "các yếu tố làm nặng thêm", "các yếu tố làm giảm bớt",
    "khởi phát cấp tính hay từ từ", "mức độ nghiêm trọng", "lan tỏa",
    "không ghi rõ", "kết luận", "phòng ngừa", "nguyên nhân", "dinh dưỡng",
)

# Clinical drug abbreviations.
DRUG_ALIASES = {
    "asa": "aspirin",
    "apap": "acetaminophen",
    "hctz": "hydrochlorothiazide",
    "mgso4": "magnesium sulfate",
    "kcl": "potassium chloride",
    "nacl": "sodium chloride",
    "ntg": "nitroglycerin",
    "asa/dipyridamole": "aspirin dipyridamole",
    "abx": "antibiotic",
    "insulin nph": "insulin isophane human",
}

# Prompt texts.
MARK_LEFT, MARK_RIGHT = "«", "»"
NONE_TOKEN = "NONE"
ASSERTION_SYSTEM = (
    "Bạn là trợ lý y khoa. Với khái niệm y tế được đánh dấu trong ngữ cảnh, hãy xác "
    "định các nhãn ngữ cảnh (assertion) áp dụng cho nó. Chỉ chọn trong ba nhãn sau, "
    "và CHỈ khi ngữ cảnh nêu rõ; nếu không có nhãn nào phù hợp, trả về danh sách rỗng.\n"
    "isNegated: khái niệm bị PHỦ ĐỊNH/không có/loại trừ/âm tính.\n"
    "isHistorical: thuộc TIỀN SỬ/bệnh cũ/đã xảy ra trước đợt khám này.\n"
    "isFamily: KHÔNG phải của bệnh nhân mà của NGƯỜI NHÀ (bố/mẹ/anh/chị...).\n"
    'Trả lời DUY NHẤT một mảng JSON, ví dụ: ["isNegated"] hoặc [].'
)
ASSERTION_SYSTEM_SHORT = (
    "Gán nhãn ngữ cảnh cho khái niệm y tế trong «». Chọn 0-3 nhãn: "
    "isNegated (phủ định), isHistorical (tiền sử), isFamily (của người nhà). "
    'Chỉ in mảng JSON, vd ["isNegated"] hoặc [].'
)
RERANK_SYSTEM = (
    "Bạn là chuyên gia mã hoá y khoa. Cho một khái niệm y tế và danh sách mã ứng viên "
    "(kèm mô tả), hãy chọn ĐÚNG MỘT mã khớp nhất về mặt lâm sàng. Nếu KHÔNG mã nào thực "
    "sự khớp, trả về NONE. Chỉ in ra mã đã chọn hoặc NONE, không giải thích."
)
PROMPT_TYPE = "Loại khái niệm: "
PROMPT_CONCEPT = "Khái niệm: "
PROMPT_CONTEXT = "Ngữ cảnh: "
PROMPT_LABELS = "Các nhãn áp dụng (mảng JSON):"
PROMPT_KIND = "Loại: "
PROMPT_CODES = "Mã ứng viên:"
PROMPT_BEST = "Mã khớp nhất (hoặc NONE):"

# Section grammar of synthetic records.
# (level-1 titles, [(level-2 titles, [(type, required assertion or None)])]).
SECTIONS = (
    (("Tiền sử bệnh", "Tiền sử bệnh nội khoa", "Tiền sử bệnh lý", "Tiền sử bệnh nội"), (
        (("Các bệnh lý mạn tính", "Các bệnh lý mãn tính", "Các bệnh mãn tính",
          "Bệnh lý mãn tính", "Tiền sử bệnh nội khoa"),
         (("CHẨN_ĐOÁN", "isHistorical"),)),
        (("Thuốc trước khi nhập viện", "Thuốc trước khi nhập viện lần này",
          "Bệnh nhân có tiền sử dụng thuốc"),
         (("THUỐC", "isHistorical"),)),
        (("Tiền sử phẫu thuật / thủ thuật", "Tiền sử phẫu thuật"),
         (("CHẨN_ĐOÁN", "isHistorical"), ("TÊN_XÉT_NGHIỆM", None))),
        (("Các tập tương tự trước đây", "Các tập phát bệnh tương tự trước đây",
          "Ghi nhận triệu chứng tương tự trước đây"),
         (("TRIỆU_CHỨNG", "isHistorical"),)),
    )),
    (("Tiền sử bệnh hiện tại", "Bệnh sử hiện tại", "Bệnh sử"), (
        (("Lý do nhập viện", "Lý do vào viện"), (("TRIỆU_CHỨNG", None),)),
        (("Triệu chứng khi nhập viện", "Các triệu chứng hiện tại", "Triệu chứng hiện tại"),
         (("TRIỆU_CHỨNG", None),)),
        (("Diễn biến bệnh",), (("TRIỆU_CHỨNG", None), ("CHẨN_ĐOÁN", None))),
        (("Đặc điểm triệu chứng",), (("TRIỆU_CHỨNG", None),)),
        (("Các sự kiện trước khi nhập viện", "Sự kiện trước khi nhập viện",
          "Tình trạng ngay trước khi nhập viện"),
         (("TRIỆU_CHỨNG", "isHistorical"), ("TÊN_XÉT_NGHIỆM", None))),
    )),
    (("Đánh giá tại bệnh viện", "Khám tại bệnh viện", "Cận lâm sàng"), (
        (("Dấu hiệu lâm sàng", "Toàn trạng"), (("TRIỆU_CHỨNG", None),)),
        (("Kết quả xét nghiệm",), (("TÊN_XÉT_NGHIỆM", None), ("KẾT_QUẢ_XÉT_NGHIỆM", None))),
        (("Kết quả chẩn đoán hình ảnh", "Chẩn đoán hình ảnh"),
         (("KẾT_QUẢ_XÉT_NGHIỆM", None), ("TÊN_XÉT_NGHIỆM", None))),
        (("Các thủ thuật đã thực hiện",), (("TÊN_XÉT_NGHIỆM", None),)),
        (("Các phát hiện chẩn đoán khác", "Chẩn đoán"), (("CHẨN_ĐOÁN", None),)),
    )),
    (("Điều trị", "Điều trị tại bệnh viện"), (
        (("Thuốc điều trị", "Thuốc đã dùng"), (("THUỐC", None),)),
    )),
)
NOISE_PAIRS = (
    ("Vị trí", "Không ghi rõ"), ("Thời gian", "Không ghi rõ"),
    ("Mức độ nghiêm trọng", "Không ghi rõ"), ("Tần suất", "Không ghi rõ"),
    ("Lan tỏa", "Không ghi rõ"), ("Các yếu tố làm nặng thêm", "Không ghi rõ"),
    ("Các yếu tố làm giảm bớt", "Không ghi rõ"), ("Khởi phát cấp tính hay từ từ", "Không ghi rõ"),
)
NOISE_LINES = (
    "Không ghi rõ", "Không có tiền sử bệnh nào được biết đến", "Không rõ đơn",
    "Chưa ghi nhận bất thường",
)
QUESTION_OPENINGS = (
    "Câu hỏi từ người dùng:", "Câu hỏi từ người dùng :",
    "Câu hỏi của người dùng gửi đến hệ thống", "Hỏi :",
)
ANSWER_OPENINGS = ("Câu trả lời của bác sĩ:", "Câu trả lời của bác sĩ:  ", "Trả lời:")
ANSWER_GREETINGS = (
    "Chào bạn, cảm ơn bạn đã gửi câu hỏi cho chúng tôi.",
    "Chào bạn! Cảm ơn bạn đã gửi câu hỏi cho chúng tôi.",
    "Chào bạn, mình xin trả lời câu hỏi của bạn như sau.",
)
NEGATION_PREFIXES = ("Phủ nhận ", "không ", "không ghi nhận ", "âm tính với ")
BULLETS = ("- ", " - ", "    - ", " • ", "-        ")

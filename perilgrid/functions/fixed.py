"""Names, thresholds and texts that results must agree on."""

from __future__ import annotations

#: Standard columns of damage history and school zones.
DAMAGE_COLUMNS = [
    "category_no",
    "hazard_type",
    "collected_at",
    "lat",
    "lon",
    "node_link",
    "start_node",
    "end_node",
    "road_address",
    "base_date",
]
ZONE_COLUMNS = ["zone_name", "lat", "lon", "address", "sido", "sigungu", "facility_kind"]

#: Header names of the damage history, by standard column.
DAMAGE_HEADERS = {
    "category_no": ["분류번호", "분류no", "관리번호", "일련번호", "id"],
    "hazard_type": ["위험물유형", "위험물종류", "파손유형", "유형", "위험물유형명", "hazardtype"],
    "collected_at": ["수집날짜", "수집일자", "수집일", "발생일자", "collecteddate"],
    "lat": ["위도", "위도y", "lat", "latitude", "y좌표"],
    "lon": ["경도", "경도x", "lon", "lng", "longitude", "x좌표"],
    "node_link": ["노드링크", "노드링크id", "링크id", "nodelink"],
    "start_node": ["시작노드", "시작노드id", "startnode"],
    "end_node": ["끝노드", "종료노드", "끝노드id", "endnode"],
    "road_address": ["도로명주소", "도로명", "소재지도로명주소", "주소", "roadaddress"],
    "base_date": ["데이터기준일자", "데이터기준일", "기준일자", "basedate"],
}
#: Header names of school zones, by standard column.
ZONE_HEADERS = {
    "zone_name": ["대상시설명", "시설명", "학교명", "명칭"],
    "lat": ["위도", "lat", "latitude"],
    "lon": ["경도", "lon", "lng", "longitude"],
    "address": ["소재지도로명주소", "소재지지번주소", "도로명주소", "지번주소", "주소"],
    "sido": ["시도명", "시도"],
    "sigungu": ["시군구명", "시군구"],
    "facility_kind": ["대상시설종류", "시설종류"],
}
#: Encodings, in the order tried.
ENCODINGS = ("utf-8-sig", "cp949", "euc-kr", "utf-8")
#: What the CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

#: Why rows are left out.
LAT_MISSING, LAT_NOT_NUMERIC = "위도 값 없음", "위도 값이 숫자가 아님"
LON_MISSING, LON_NOT_NUMERIC = "경도 값 없음", "경도 값이 숫자가 아님"
OUT_OF_BBOX = "안양시 좌표 범위를 벗어남"

#: The city's box (both ends count) and centre, and the region's keyword.
BBOX = {"lat_min": 37.34, "lat_max": 37.46, "lon_min": 126.87, "lon_max": 127.00}
CENTRE = (37.3943, 126.9568)
KEYWORD = "안양"
EARTH_M = 6_371_000.0

#: Risk weights and labels.
WEIGHTS = {"history_density": 0.30, "photo_severity": 0.25, "school_zone": 0.20, "road_importance": 0.15, "rainfall": 0.10}
LABELS = {
    "history_density": "과거 파손 이력 밀도",
    "photo_severity": "사진상 파손 정도",
    "school_zone": "어린이보호구역 인접도",
    "road_importance": "도로구간 중요도",
    "rainfall": "강수 영향",
}
NO_FORMULA = "사용 가능한 입력 항목이 없어 총점을 계산할 수 없습니다."

#: Thresholds.
ZONE_LIMIT_M, RADIUS_M, REFERENCE_COUNT, RAIN_FULL_MM = 500.0, 300.0, 20, 30.0
EPS_M, MIN_SAMPLES = 150.0, 5
CLASS_WEIGHTS = {"D40": 1.0, "D20": 0.8, "D10": 0.6, "D00": 0.6}
OTHER_CLASS = 0.5
CONFIDENCE, NMS_IOU, SUPPRESS_IOU = 0.25, 0.45, 0.3
CLASSES = ["D00", "D10", "D20", "D40"]

#: Case statuses in order, and the first history note.
STATUSES = ["접수", "수동검토", "점검예정", "현장확인", "보수필요", "처리완료"]
NEW_CASE_NOTE = "신규 접수"

#: Rain texts.
NO_RAIN = ["", "강수없음", "-", "null", "None"]
BELOW = "미만"
#: How the reason of an unexpected forecast answer begins.
BAD_ANSWER = "기상청 응답 형식이 예상과 다릅니다: "

#: Labels of flags.
DONE_LABELS, SAMPLE_LABELS = ("예", "아니오"), ("샘플", "실데이터")

#: Labels of the case list.
CASE_LABELS = {
    "id": "번호",
    "created_at": "접수시각",
    "status": "처리상태",
    "lat": "위도",
    "lon": "경도",
    "road_address": "도로명",
    "ai_available": "AI 분석 수행",
    "ai_top_class": "AI 최고 유형",
    "ai_top_confidence": "AI 신뢰도",
    "ai_risk_score": "우선순위 점수",
    "reviewer_judgement": "담당자 확인 결과",
    "is_sample_data": "샘플데이터",
}

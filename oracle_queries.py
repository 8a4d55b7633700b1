"""Plain SQL for every registered query, over the same Parquet tables.

The building blocks below are common table expressions; ``sql`` puts in front of a query the ones
it needs. Money is decimal before any arithmetic; rounded averages and percentages are worked out
on whole cents, halves away from zero, so that no engine's decimal division rule matters.
"""

from __future__ import annotations

import re

from mercato.schemas import LOAD_ORDER

TS = "%Y-%m-%d %H:%M:%S.%f"

#: The statuses that an order can have.
STATUSES = """('created', 'approved', 'invoiced', 'processing', 'shipped', 'delivered', 'unavailable', 'canceled')"""
PAYMENT_TYPES = "('credit_card', 'boleto', 'voucher', 'debit_card', 'not_defined')"

BLOCKS = {
    # Raw tables.
    "raw_geolocation": """
        select case when c_custkey % 50 <> 9 then cast(c_nationkey as varchar) end as geolocation_zip_code_prefix,
               case when c_custkey % 5 <> 4
                    then cast(cast(c_acctbal as decimal(12,2)) / 1000 as decimal(12,6))
                         + case when c_nationkey = 7 then 5000 else 0 end end as geolocation_lat,
               cast(-cast(c_acctbal as decimal(12,2)) / 1000 as decimal(12,6)) as geolocation_lng,
               case when c_custkey % 6 <> 1 then 'CITY_' || c_nationkey end as geolocation_city,
               lpad(cast(c_nationkey as varchar), 2, '0') as geolocation_state,
               c_custkey as arrival
        from customer""",
    "raw_translation": """
        select distinct p_type as product_category_name,
               case when p_type <> 'ECONOMY' then lower(p_type) || case when p_size % 2 = 0 then '' else ' goods' end
               end as product_category_name_english
        from part""",
    "raw_customers": """
        select case when c_custkey % 200 = 3 then c_custkey - 1 else c_custkey end as customer_id,
               case when c_custkey % 50 <> 0 then c_name end as customer_unique_id,
               case when c_custkey % 10 = 4 then '777'
                    when c_custkey % 50 <> 9 then cast(c_nationkey as varchar) end as customer_zip_code_prefix,
               'CITY_' || c_nationkey as customer_city,
               lpad(cast(c_nationkey as varchar), 2, '0') as customer_state, c_custkey as arrival
        from customer""",
    "raw_sellers": """
        select case when s_suppkey % 100 = 9 then null when s_suppkey % 200 = 3 then s_suppkey - 1
                    else s_suppkey end as seller_id,
               case when s_suppkey % 10 = 5 then '777' else cast(s_nationkey as varchar) end as seller_zip_code_prefix,
               'CITY_' || s_nationkey as seller_city, lpad(cast(s_nationkey as varchar), 2, '0') as seller_state,
               s_suppkey as arrival
        from supplier""",
    "raw_products": """
        select case when p_partkey % 100 = 29 then null when p_partkey % 200 = 3 then p_partkey - 1
                    else p_partkey end as product_id,
               case p_partkey % 9 when 4 then 'UNLISTED' when 5 then null else p_type end as product_category_name,
               case p_partkey % 200 when 38 then 0 when 39 then 40000 else length(p_name) end as product_name_lenght,
               case when p_partkey % 200 = 35 then -10 else length(p_name) * 10 end as product_description_lenght,
               case when p_partkey % 200 = 37 then -1 else p_size % 5 end as product_photos_qty,
               p_size - 1 as product_weight_g, case when p_partkey % 200 = 34 then 0 else p_size end as product_length_cm,
               case when p_partkey % 200 = 36 then -(p_size % 20 + 1) else p_size % 20 + 1 end as product_height_cm,
               case when p_partkey % 200 = 33 then 0 else p_size % 30 + 1 end as product_width_cm, p_partkey as arrival
        from part""",
    "raw_orders": """
        select case when o_orderkey % 200 = 3 then o_orderkey - 1 else o_orderkey end as order_id,
               o_custkey as customer_id,
               case when o_orderkey % 200 = 17 then null else case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped'
                    else case when o_orderkey % 10 = 0 then 'bogus' else 'processing' end end end as order_status,
               o_orderdate + to_hours(o_orderkey % 24) as order_purchase_timestamp,
               o_orderdate + to_hours(o_orderkey % 24) + to_hours(o_orderkey % 48) as order_approved_at,
               case when o_orderstatus in ('F', 'O')
                    then o_orderdate + to_hours(o_orderkey % 24) + to_days(2) end as order_delivered_carrier_date,
               case when o_orderstatus = 'F'
                    then o_orderdate + to_days(cast(o_orderkey * 7919 % 60 as integer))
                         + to_hours(o_orderkey % 24) end as order_delivered_customer_date,
               o_orderdate + to_days(30) as order_estimated_delivery_date, o_orderkey as arrival
        from orders""",
    "raw_order_items": """
        select l_orderkey as order_id, l_linenumber as order_item_id,
               case when l_partkey % 200 <> 14 then l_partkey end as product_id, l_suppkey as seller_id,
               l_shipdate as shipping_limit_date,
               case l_partkey % 200 when 10 then 123456789 when 13 then -cast(l_extendedprice as decimal(12,2))
                    when 11 then null
                    else cast(l_extendedprice as decimal(12,2)) end as price,
               case when l_partkey % 200 <> 12
                    then cast(round(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)), 2)
                              as decimal(12,2)) * case when l_partkey % 200 = 19 then -1 else 1 end
                         - case when l_partkey % 200 = 19 then 1 else 0 end end as freight_value,
               row_number() over (partition by l_orderkey, l_linenumber
                    order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                             l_returnflag, l_linestatus) as arrival
        from lineitem""",
    "raw_payments": """
        select l_orderkey as order_id, l_linenumber as payment_sequential,
               case when l_partkey % 200 = 15 then 'cheque' when l_returnflag = 'R' then 'credit_card'
                    when l_returnflag = 'A' then 'boleto' else 'voucher' end as payment_type,
               cast(l_quantity as integer) % 11 as payment_installments,
               case l_partkey % 200 when 18 then 123456789 when 17 then -cast(l_extendedprice as decimal(12,2))
                    when 16 then null
                    else cast(l_extendedprice as decimal(12,2)) end as payment_value,
               row_number() over (partition by l_orderkey, l_linenumber
                    order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                             l_returnflag, l_linestatus) as arrival
        from lineitem""",
    "raw_reviews": """
        select case when event_id % 40 = 9 then event_id - 1 else event_id end as review_id,
               event_id - event_id % 3 as order_id,
               case when event_id % 40 <> 7 then cast(floor(value) as integer) % 6 end as review_score, event_type as review_comment_title,
               props as review_comment_message, ts as review_creation_date,
               ts + to_days(1) as review_answer_timestamp, event_id as arrival
        from events""",
    # Clean tables.
    "first_geo": """
        select * exclude (arrival) from raw_geolocation
        where geolocation_zip_code_prefix is not null and geolocation_lat is not null
        qualify row_number() over (partition by geolocation_zip_code_prefix order by arrival) = 1""",
    "geo": """
        select * replace (lpad(geolocation_zip_code_prefix, 5, '0') as geolocation_zip_code_prefix)
        from first_geo where geolocation_city is not null and geolocation_lat < 1000""",
    "translation": """
        select * from raw_translation where product_category_name_english is not null
        qualify row_number() over (partition by product_category_name order by product_category_name_english) = 1""",
    "customers": """
        select customer_id, customer_unique_id, geolocation_zip_code_prefix as customer_zip_code_prefix,
               customer_city, customer_state
        from raw_customers
        left join geo on lpad(customer_zip_code_prefix, 5, '0') = geolocation_zip_code_prefix
        where customer_unique_id is not null
        qualify row_number() over (partition by customer_id order by arrival) = 1""",
    "sellers": """
        select seller_id, geolocation_zip_code_prefix as seller_zip_code_prefix, seller_city, seller_state
        from raw_sellers
        left join geo on lpad(seller_zip_code_prefix, 5, '0') = geolocation_zip_code_prefix
        where seller_id is not null
        qualify row_number() over (partition by seller_id order by arrival) = 1""",
    "first_products": """
        select * from raw_products where product_id is not null and product_weight_g > 0
        qualify row_number() over (partition by product_id order by arrival) = 1""",
    "checked_products": """
        select * from first_products
        where product_name_lenght > 0 and product_description_lenght >= 0 and product_photos_qty >= 0
          and product_length_cm > 0 and product_height_cm > 0 and product_width_cm > 0""",
    "products": """
        select p.* replace (case when p.product_category_name in (select product_category_name from translation)
                            then p.product_category_name end as product_category_name)
        from checked_products p where product_name_lenght <= 32767""",
    "first_ord": """
        select * from raw_orders where order_status is not null
        qualify row_number() over (partition by order_id order by arrival) = 1""",
    "ord": f"""
        select * from first_ord
        where customer_id in (select customer_id from customers) and order_status in {STATUSES}""",
    "first_items": """
        select * exclude (arrival) from raw_order_items where product_id is not null
        qualify row_number() over (partition by order_id, order_item_id order by arrival) = 1""",
    "known_items": """
        select * from first_items
        where order_id in (select order_id from ord)
          and product_id in (select product_id from products) and seller_id in (select seller_id from sellers)""",
    "valid_items": "select * from known_items where price >= 0 and freight_value >= 0",
    "items": "select * from valid_items where price < 100000000",
    "valid_payments": f"""
        select * from raw_payments
        where payment_type in {PAYMENT_TYPES} and payment_installments >= 1 and payment_value >= 0""",
    "payments": """
        select * exclude (arrival) from valid_payments
        where payment_value < 100000000 and order_id in (select order_id from ord)
        qualify row_number() over (partition by order_id, payment_sequential order by arrival) = 1""",
    "one_per_review": """
        select * from raw_reviews
        where order_id in (select order_id from ord) and review_score between 1 and 5
        qualify row_number() over (partition by review_id order by review_creation_date, arrival) = 1""",
    "reviews": """
        select * from one_per_review
        qualify row_number() over (partition by order_id order by review_creation_date, arrival) = 1""",
    # What is stored from messy text: the same tables less the rows and values that the mess spoils.
    "csv_geo": """
        select * from (
            select * from raw_geolocation
            where arrival % 7 <> 0 and geolocation_zip_code_prefix is not null and geolocation_lat is not null
            qualify row_number() over (partition by geolocation_zip_code_prefix order by arrival) = 1)
        where arrival % 11 <> 0 and geolocation_city is not null and geolocation_lat < 1000""",
    "csv_translation": "select * from translation where product_category_name not like 'S%'",
    "csv_customers": """
        select customer_id, customer_unique_id, lpad(geolocation_zip_code_prefix, 5, '0') as customer_zip_code_prefix,
               case when customer_id % 9 <> 0 then customer_city end as customer_city, customer_state
        from raw_customers left join csv_geo on customer_zip_code_prefix = geolocation_zip_code_prefix
        where customer_unique_id is not null
        qualify row_number() over (partition by customer_id order by raw_customers.arrival) = 1""",
    "csv_sellers": """
        select seller_id, lpad(geolocation_zip_code_prefix, 5, '0') as seller_zip_code_prefix, seller_city,
               seller_state
        from raw_sellers left join csv_geo on seller_zip_code_prefix = geolocation_zip_code_prefix
        where seller_id is not null
        qualify row_number() over (partition by seller_id order by raw_sellers.arrival) = 1""",
    "csv_products": """
        select p.* replace (
                   case when product_category_name in (select product_category_name from csv_translation)
                        then product_category_name end as product_category_name,
                   case when product_id % 10 <> 3 then product_photos_qty end as product_photos_qty)
        from checked_products p where product_id % 10 not in (0, 2, 5) and product_name_lenght <= 32767""",
    "csv_ord": """
        select * replace (case when order_id % 10 <> 1 then order_approved_at end as order_approved_at)
        from first_ord
        where customer_id in (select customer_id from csv_customers) and order_status <> 'bogus'""",
    "csv_items": """
        select * from first_items
        where price >= 0 and price < 100000000 and freight_value >= 0 and order_id in (select order_id from csv_ord)
          and product_id in (select product_id from csv_products) and product_id % 40 not in (0, 1, 2, 3, 6)
          and seller_id in (select seller_id from csv_sellers) and seller_id % 30 <> 0""",
    "csv_payments": """
        select * from valid_payments
        where payment_value < 100000000 and order_id in (select order_id from csv_ord)
          and cast(payment_value * 100 as bigint) % 40 not in (0, 1, 2, 3, 7, 8)
        qualify row_number() over (partition by order_id, payment_sequential order by arrival) = 1""",
    "csv_one_per_review": """
        select * from raw_reviews
        where order_id in (select order_id from csv_ord) and review_score between 1 and 5 and review_id % 4 <> 1
        qualify row_number() over (partition by review_id order by review_creation_date, arrival) = 1""",
    "csv_reviews": """
        select * from csv_one_per_review
        qualify row_number() over (partition by order_id order by review_creation_date, arrival) = 1""",
    # Staging.
    "stg_orders": """
        select order_id, customer_id, order_status, order_purchase_timestamp as purchased_at,
               order_approved_at as approved_at, order_delivered_carrier_date as shipped_at,
               order_delivered_customer_date as delivered_at,
               order_estimated_delivery_date as estimated_delivery_at,
               (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date))
                   / 86400000000.0::double as delivery_delay_days,
               coalesce(order_delivered_customer_date <= order_estimated_delivery_date, false) as is_on_time
        from ord""",
    "stg_customers": """
        select customer_id, customer_unique_id, customer_zip_code_prefix as zip_code, customer_city as city,
               customer_state as state from customers""",
    "stg_sellers": """
        select seller_id, seller_zip_code_prefix as zip_code, seller_city as city, seller_state as state
        from sellers""",
    "stg_products": """
        select product_id, p.product_category_name, product_category_name_english as category_name_english,
               product_name_lenght as product_name_length, product_description_lenght as product_description_length,
               product_photos_qty, product_weight_g as weight_g, product_length_cm as length_cm,
               product_height_cm as height_cm, product_width_cm as width_cm
        from products p left join translation t on p.product_category_name = t.product_category_name""",
    "stg_items": "select *, price + freight_value as total_amount from items",
    "stg_reviews": """
        select *, case when review_score >= 4 then 'positive' when review_score = 3 then 'neutral'
                  else 'negative' end as sentiment from reviews""",
    # The order fact.
    "fct": """
        select o.*, item_count, total_price, total_freight, total_order_value, total_payment, payment_count,
               primary_payment_type, review_score, sentiment
        from stg_orders o
        left join (select order_id, count(*) as item_count, sum(price) as total_price,
                          sum(freight_value) as total_freight, sum(total_amount) as total_order_value
                   from stg_items group by order_id) i on o.order_id = i.order_id
        left join (select order_id, sum(payment_value) as total_payment, count(*) as payment_count,
                          max(payment_type) as primary_payment_type
                   from payments group by order_id) p on o.order_id = p.order_id
        left join stg_reviews r on o.order_id = r.order_id""",
    # Reports.
    "footprint": """
        select seller_id, count(distinct customer_state) as states_reached,
               count(distinct o.order_id) as total_orders,
               cast(sum(price + freight_value) * 100 as bigint) as cents, count(*) as n
        from items i join ord o on i.order_id = o.order_id join customers c on o.customer_id = c.customer_id
        where order_status = 'delivered'
        group by seller_id having count(distinct o.order_id) >= 3""",
    "by_state": """
        select customer_state, count(distinct o.order_id) as total_orders, count(*) as n,
               (2 * sum(payment_installments) * 100 + count(*)) // (2 * count(*)) as installments,
               (2 * cast(sum(payment_value) * 100 as bigint) + count(*)) // (2 * count(*)) as cents,
               sum(payment_value) as revenue,
               sum(case when payment_installments > 1 then 1 else 0 end) as split
        from payments p join ord o on p.order_id = o.order_id join customers c on o.customer_id = c.customer_id
        where order_status = 'delivered' and payment_type = 'credit_card'
        group by customer_state having count(distinct o.order_id) >= 100""",
    "monthly": """
        select strftime(order_purchase_timestamp, '%Y-%m') as month, count(distinct o.order_id) as total_orders,
               cast(sum(price + freight_value) * 100 as bigint) as cents,
               count(distinct seller_id) as active_sellers
        from ord o join items i on o.order_id = i.order_id
        where order_status = 'delivered' group by 1""",
    "monthly_change": "select *, lag(cents) over (order by month) as prev from monthly",
    "growth": """
        select *, sign(cents - prev) * ((20000 * abs(cents - prev) + prev) // (2 * prev)) / 100.0::double as pct
        from monthly_change""",
}


def sql(query: str) -> str:
    """The query with the blocks it uses, and those they use, in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in BLOCKS.items():
            if name not in needed and re.search(rf"(?:from|join)\s+{name}\b", text):
                need(body)
                needed.append(name)

    need(query)
    blocks = ",\n".join(f"{name} as ({BLOCKS[name]})" for name in needed)
    if needed and query.lstrip().startswith("with "):
        return f"with {blocks},\n{query.lstrip()[5:]}"
    return f"with {blocks}\n{query}" if needed else query


def times(*columns: str) -> str:
    return ", ".join(f"strftime({c}, '{TS}') as {c}" for c in columns)


def doubles(*columns: str) -> str:
    return ", ".join(f"cast({c} as double) as {c}" for c in columns)


def longs(*columns: str) -> str:
    return ", ".join(f"cast({c} as bigint) as {c}" for c in columns)


def share(part: str, whole: str) -> str:
    """Percentage with two digits, halves up, from whole numbers that are not negative."""
    return f"cast((20000 * ({part}) + ({whole})) // (2 * ({whole})) as double) / 100"


ORDER_TIMES = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
STG_TIMES = ("purchased_at", "approved_at", "shipped_at", "delivered_at", "estimated_delivery_at")
REVIEW_TIMES = ("review_creation_date", "review_answer_timestamp")
PRODUCT_SIZES = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
PRODUCT_COUNTS = ("product_name_lenght", "product_description_lenght", "product_photos_qty")

GEO = f"""select geolocation_zip_code_prefix, {doubles("geolocation_lat", "geolocation_lng")}, geolocation_city,
       geolocation_state from geo"""
ORDERS = f"select order_id, customer_id, order_status, {times(*ORDER_TIMES)} from ord"
ITEMS = f"""select order_id, {longs("order_item_id")}, product_id, seller_id, {times("shipping_limit_date")},
       {doubles("price", "freight_value")} from items"""
PAYMENTS = f"""select order_id, {longs("payment_sequential")}, payment_type, {longs("payment_installments")},
       {doubles("payment_value")} from payments"""
REVIEWS = f"""select review_id, order_id, {longs("review_score")}, review_comment_title, review_comment_message,
       {times(*REVIEW_TIMES)} from reviews"""
PRODUCTS = f"""select product_id, product_category_name, {longs(*PRODUCT_COUNTS)}, {doubles(*PRODUCT_SIZES)}
       from products"""
FCT = f"""select order_id, customer_id, order_status, {times(*STG_TIMES)}, delivery_delay_days, is_on_time,
       {longs("item_count")}, {doubles("total_price", "total_freight", "total_order_value", "total_payment")},
       {longs("payment_count")}, primary_payment_type, {longs("review_score")}, sentiment from fct"""

def texts(*columns: str) -> str:
    return ", ".join(f"cast({c} as varchar) as {c}" for c in columns)


#: What a load of messy CSV files stores; the files hold times by the second.
FROM_CSV = {
    "geolocation": f"""select lpad(geolocation_zip_code_prefix, 5, '0') as geolocation_zip_code_prefix,
        {doubles("geolocation_lat", "geolocation_lng")}, geolocation_city, geolocation_state from csv_geo""",
    "product_category_name_translation": "select * from csv_translation",
    "customers": "select * replace (cast(customer_id as varchar) as customer_id) from csv_customers",
    "sellers": "select * replace (cast(seller_id as varchar) as seller_id) from csv_sellers",
    "products": f"""select {texts("product_id")}, product_category_name, {longs(*PRODUCT_COUNTS)},
        {doubles(*PRODUCT_SIZES)} from csv_products""",
    "orders": f"""select {texts("order_id", "customer_id")}, order_status, {times(*ORDER_TIMES)} from csv_ord""",
    "order_items": f"""select {texts("order_id", "product_id", "seller_id")}, {longs("order_item_id")},
        {times("shipping_limit_date")}, {doubles("price", "freight_value")} from csv_items""",
    "payments": f"""select {texts("order_id")}, {longs("payment_sequential")}, payment_type,
        {longs("payment_installments")}, {doubles("payment_value")} from csv_payments""",
    "order_reviews": f"""select {texts("review_id", "order_id")}, {longs("review_score")},
        case when review_comment_title <> 'error' then review_comment_title end as review_comment_title,
        'He said "' || review_comment_title || chr(34) || ',' || chr(10) || review_comment_message
            as review_comment_message, {times(*REVIEW_TIMES)}
        from (select * replace (
                  case when review_id % 10 <> 3
                       then date_trunc('second', review_creation_date) end as review_creation_date,
                  date_trunc('second', review_answer_timestamp) as review_answer_timestamp) from csv_reviews)""",
}

#: The blocks of the clean tables, in the order of loading.
_CLEAN_BLOCKS = ("geo", "translation", "customers", "sellers", "products", "ord", "items", "payments", "reviews")

REACH = """
select r.seller_id, s.seller_city, s.seller_state, states_reached, total_orders, cents / 100.0::double as total_revenue,
       ((2 * cents + n) // (2 * n)) / 100.0::double as avg_order_value,
       case when states_reached > 8 then 'national' when states_reached > 1 then 'regional'
            when states_reached = 1 then 'local' end as seller_tier,
       geo_rank, rev_rank, rev_rank - geo_rank as efficiency_gap
from (select *, rank() over (order by states_reached desc nulls first) as geo_rank,
             rank() over (order by cents desc nulls first) as rev_rank from footprint) r
join sellers s on r.seller_id = s.seller_id
order by geo_rank, r.seller_id limit 50"""

INSTALLMENTS = f"""
select customer_state, total_orders, installments / 100.0::double as avg_installments,
       cents / 100.0::double as avg_payment_value, cast(revenue as double) as total_revenue,
       {share("split", "n")} as pct_installment_orders,
       case ntile(4) over (order by installments desc nulls first, customer_state)
            when 1 then 'high installment state' when 2 then 'above average'
            when 3 then 'below average' when 4 then 'low installment state' end as installment_profile,
       rank() over (order by installments desc nulls first) as installment_rank,
       rank() over (order by cents desc nulls first) as spending_rank,
       sign(installments * states - total)
           * ((2 * abs(installments * states - total) + states) // (2 * states)) / 100.0::double as diff_from_avg
from by_state, (select count(*) as states, sum(installments) as total from by_state)"""

TREND = """
select month, total_orders, cents / 100.0::double as monthly_revenue, active_sellers,
       cast(sum(cents) over (order by month rows between unbounded preceding and current row) as bigint)
           / 100.0::double as cumulative_revenue,
       prev / 100.0::double as prev_month_revenue, pct as mom_growth_pct,
       case when pct > 0 then 'growth' when pct < 0 then 'decline' when pct = 0 then 'flat'
            else 'first month' end as trend
from growth"""

DATES = """
select distinct strftime(purchased_at, '%Y-%m-%d') as date_day, year(purchased_at) as year_num,
       month(purchased_at) as month_num, day(purchased_at) as day_num, dayofweek(purchased_at) as day_of_week,
       rpad(monthname(purchased_at), 9, ' ') as month_name, rpad(dayname(purchased_at), 9, ' ') as day_name,
       dayofweek(purchased_at) in (0, 6) as is_weekend
from stg_orders where purchased_at is not null"""


def _chain(table: str, *steps: tuple[str, str]) -> str:
    """Rows left after each rule of a table, and how many it dropped."""
    union = " union all ".join(
        f"select {n} as step, '{rule}' as rule, ({count}) as rows_left" for n, (rule, count) in enumerate(steps)
    )
    return f"""select '{table}' as table_name, step, rule, rows_left,
        coalesce(lag(rows_left) over (order by step) - rows_left, 0) as rows_dropped from ({union})"""


_READABLE = "customer_id % 10 not in (1, 3, 6)"
_KNOWN_ORDER = "order_id in (select order_id from ord)"
_KNOWN_CUSTOMER = "customer_id in (select customer_id from customers)"
REJECTS = " union all ".join(
    [
        _chain(
            "geolocation",
            ("input", "select count(*) from raw_geolocation"),
            ("missing geolocation_zip_code_prefix", "select count(geolocation_zip_code_prefix) from raw_geolocation"),
            (
                "missing geolocation_lat, geolocation_lng",
                "select count(geolocation_zip_code_prefix) from raw_geolocation where geolocation_lat is not null",
            ),
            ("repeated zip", "select count(*) from first_geo"),
            (
                "missing geolocation_city, geolocation_state",
                "select count(*) from first_geo where geolocation_city is not null",
            ),
            ("does not fit its column", "select count(*) from geo"),
        ),
        _chain(
            "product_category_name_translation",
            ("input", "select count(*) from raw_translation"),
            (
                "missing product_category_name, product_category_name_english",
                "select count(product_category_name_english) from raw_translation",
            ),
            ("repeated category", "select count(*) from translation"),
        ),
        _chain(
            "customers",
            ("input", "select count(*) from raw_customers"),
            ("missing customer_id, customer_unique_id", "select count(customer_unique_id) from raw_customers"),
            ("repeated customer", "select count(*) from customers"),
        ),
        _chain(
            "sellers",
            ("input", "select count(*) from raw_sellers"),
            ("missing seller_id", "select count(seller_id) from raw_sellers"),
            ("repeated seller", "select count(*) from sellers"),
        ),
        _chain(
            "products",
            ("input", "select count(*) from raw_products"),
            ("missing product_id", "select count(product_id) from raw_products"),
            ("weight not positive", "select count(product_id) from raw_products where product_weight_g > 0"),
            ("repeated product", "select count(*) from first_products"),
            ("breaks a check", "select count(*) from checked_products"),
            ("does not fit its column", "select count(*) from products"),
        ),
        _chain(
            "orders",
            ("input", "select count(*) from raw_orders"),
            ("missing order_id, customer_id, order_status", "select count(order_status) from raw_orders"),
            ("repeated order", "select count(*) from first_ord"),
            ("unknown customer_id", f"select count(*) from first_ord where {_KNOWN_CUSTOMER}"),
            ("unknown status", "select count(*) from ord"),
        ),
        _chain(
            "order_items",
            ("input", "select count(*) from raw_order_items"),
            ("missing order_id, order_item_id, product_id, seller_id", "select count(product_id) from raw_order_items"),
            ("repeated line", "select count(*) from first_items"),
            ("unknown order_id", f"select count(*) from first_items where {_KNOWN_ORDER}"),
            (
                "unknown product_id",
                f"select count(*) from first_items where {_KNOWN_ORDER}"
                " and product_id in (select product_id from products)",
            ),
            ("unknown seller_id", "select count(*) from known_items"),
            (
                "missing price, freight_value",
                "select count(*) from known_items where price is not null and freight_value is not null",
            ),
            ("negative amount", "select count(*) from valid_items"),
            ("does not fit its column", "select count(*) from items"),
        ),
        _chain(
            "payments",
            ("input", "select count(*) from raw_payments"),
            (
                "missing order_id, payment_sequential, payment_type, payment_installments, payment_value",
                "select count(payment_value) from raw_payments",
            ),
            ("unknown type", f"select count(payment_value) from raw_payments where payment_type in {PAYMENT_TYPES}"),
            ("out of range", "select count(*) from valid_payments"),
            ("does not fit its column", "select count(*) from valid_payments where payment_value < 100000000"),
            (
                "unknown order_id",
                f"select count(*) from valid_payments where payment_value < 100000000 and {_KNOWN_ORDER}",
            ),
            ("repeated payment", "select count(*) from payments"),
        ),
        _chain(
            "order_reviews",
            ("input", "select count(*) from raw_reviews"),
            ("missing review_id, order_id, review_score", "select count(review_score) from raw_reviews"),
            ("unknown order_id", f"select count(review_score) from raw_reviews where {_KNOWN_ORDER}"),
            (
                "score out of range",
                f"select count(*) from raw_reviews where {_KNOWN_ORDER} and review_score between 1 and 5",
            ),
            ("repeated review", "select count(*) from one_per_review"),
            ("second review of an order", "select count(*) from reviews"),
        ),
    ]
)

_TEST_MODELS = {
    "stg_orders": ("stg_orders", "order_id", ("order_id", "customer_id")),
    "stg_customers": ("stg_customers", "customer_id", ("customer_id", "customer_unique_id")),
    "stg_sellers": ("stg_sellers", "seller_id", ("seller_id",)),
    "stg_products": ("stg_products", "product_id", ("product_id",)),
    "stg_order_items": ("stg_items", None, ("order_id", "product_id", "seller_id")),
    "stg_payments": ("payments", None, ("order_id", "payment_value")),
    "stg_order_reviews": ("stg_reviews", "review_id", ("review_id",)),
    "fct_orders": ("fct", "order_id", ("order_id", "customer_id")),
    "dim_customers": ("stg_customers", "customer_id", ("customer_id",)),
    "dim_sellers": ("stg_sellers", "seller_id", ("seller_id",)),
    "dim_products": ("stg_products", "product_id", ("product_id",)),
    "dim_dates": (
        "(select distinct cast(purchased_at as date) as date_day from stg_orders)",
        "date_day",
        ("date_day",),
    ),
}


def _quality() -> str:
    tests = []
    for model, (source, key, not_null) in _TEST_MODELS.items():
        for c in not_null:
            tests.append((model, c, "not_null", f"select count(*) from {source} where {c} is null"))
        if key:
            repeated = f"select {key} from {source} where {key} is not null group by {key} having count(*) > 1"
            tests.append((model, key, "unique", f"select count(*) from ({repeated})"))
    tests.append(
        (
            "stg_orders",
            "order_status",
            "accepted_values",
            f"select count(distinct order_status) from stg_orders where order_status not in {STATUSES}",
        )
    )
    tests.append(
        (
            "stg_order_reviews",
            "review_score",
            "accepted_values",
            "select count(distinct review_score) from stg_reviews where review_score not in (1, 2, 3, 4, 5)",
        )
    )
    tests.append(
        (
            "fct_orders",
            "customer_id",
            "relationships",
            "select count(*) from fct where customer_id is not null"
            " and customer_id not in (select customer_id from stg_customers)",
        )
    )
    union = " union all ".join(
        f"select '{m}' as model, '{c}' as column_name, '{t}' as test, ({q}) as failures" for m, c, t, q in tests
    )
    return f"select *, case when failures = 0 then 'PASS' else 'FAIL' end as status from ({union})"


_RAW = {
    "geolocation": "raw_geolocation",
    "product_category_name_translation": "raw_translation",
    "customers": "raw_customers",
    "sellers": "raw_sellers",
    "products": "raw_products",
    "orders": "raw_orders",
    "order_items": "raw_order_items",
    "payments": "raw_payments",
    "order_reviews": "raw_reviews",
}


def _audit_keys() -> str:
    keys = [
        ("geolocation", "primary key", "geolocation_zip_code_prefix"),
        ("product_category_name_translation", "primary key", "product_category_name"),
        ("customers", "primary key", "customer_id"),
        ("sellers", "primary key", "seller_id"),
        ("products", "primary key", "product_id"),
        ("orders", "primary key", "order_id"),
        ("order_items", "primary key", "order_id, order_item_id"),
        ("payments", "primary key", "order_id, payment_sequential"),
        ("order_reviews", "primary key", "review_id"),
        ("order_reviews", "unique", "order_id"),
    ]
    return " union all ".join(
        f"""select '{t}' as table_name, '{kind}' as kind, '{columns}' as key_columns,
            (select count(*) from (select {columns} from {_RAW[t]} 
                where {columns.replace(",", " is not null and")} is not null group by {columns} having count(*) > 1))
            as violations"""
        for t, kind, columns in keys
    )


def _audit_foreign_keys() -> str:
    keys = [
        ("customers", "customer_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
        ("sellers", "seller_zip_code_prefix", "geolocation", "geolocation_zip_code_prefix"),
        ("products", "product_category_name", "product_category_name_translation", "product_category_name"),
        ("orders", "customer_id", "customers", "customer_id"),
        ("order_items", "order_id", "orders", "order_id"),
        ("order_items", "product_id", "products", "product_id"),
        ("order_items", "seller_id", "sellers", "seller_id"),
        ("payments", "order_id", "orders", "order_id"),
        ("order_reviews", "order_id", "orders", "order_id"),
    ]
    return " union all ".join(
        f"""select '{t}' as table_name, '{c}' as column_name, '{p}' as parent_table,
            (select count(*) from {_RAW[t]} where {c} is not null
             and {c} not in (select {pc} from {_RAW[p]} where {pc} is not null)) as violations"""
        for t, c, p, pc in keys
    )


def _audit_checks() -> str:
    checks = [
        ("products", "name_length_positive", "product_name_lenght <= 0"),
        ("products", "description_length_not_negative", "product_description_lenght < 0"),
        ("products", "photos_not_negative", "product_photos_qty < 0"),
        ("products", "weight_positive", "product_weight_g <= 0"),
        ("products", "length_positive", "product_length_cm <= 0"),
        ("products", "height_positive", "product_height_cm <= 0"),
        ("products", "width_positive", "product_width_cm <= 0"),
        ("orders", "status_known", "order_status = 'bogus'"),
        ("order_items", "price_not_negative", "price < 0"),
        ("order_items", "freight_not_negative", "freight_value < 0"),
        ("payments", "type_known", f"payment_type not in {PAYMENT_TYPES}"),
        ("payments", "installments_at_least_one", "payment_installments < 1"),
        ("payments", "value_not_negative", "payment_value < 0"),
        ("order_reviews", "score_in_range", "review_score < 1 or review_score > 5"),
    ]
    return " union all ".join(
        f"""select '{t}' as table_name, '{name}' as check_name,
            (select count(*) from {_RAW[t]} where {broken}) as violations"""
        for t, name, broken in checks
    )


def _audit_not_null() -> str:
    columns = {
        "geolocation": "geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city geolocation_state",
        "product_category_name_translation": "product_category_name product_category_name_english",
        "customers": "customer_id customer_unique_id",
        "sellers": "seller_id",
        "products": "product_id",
        "orders": "order_id customer_id order_status",
        "order_items": "order_id order_item_id product_id seller_id price freight_value",
        "payments": "order_id payment_sequential payment_type payment_installments payment_value",
        "order_reviews": "review_id order_id review_score",
    }
    return " union all ".join(
        f"""select '{t}' as table_name, '{c}' as column_name,
            (select count(*) from {_RAW[t]} where {c} is null) as violations"""
        for t, names in columns.items()
        for c in names.split()
    )


_LOADED = {
    "geolocation": "geo",
    "product_category_name_translation": "translation",
    "customers": "customers",
    "sellers": "sellers",
    "products": "products",
    "orders": "ord",
    "order_items": "items",
    "payments": "payments",
    "order_reviews": "reviews",
}
TWICE = " union all ".join(
    f"""select '{t}' as table_name, (select count(*) from {b}) as inserted_first, 0 as inserted_again,
        (select count(*) from {b}) as stored"""
    for t, b in _LOADED.items()
)

DELAY = f"""
select case when delivery_delay_days is null then 'not delivered' when delivery_delay_days <= 0 then 'on time'
            when delivery_delay_days <= 3 then 'up to 3 days late'
            when delivery_delay_days <= 7 then 'up to 7 days late' else 'over 7 days late' end as delay_bucket,
       count(*) as total_orders, count(review_score) as reviewed_orders,
       cast((200 * sum(review_score) + count(review_score)) // (2 * count(review_score)) as double) / 100
           as avg_review_score,
       count(case when sentiment = 'positive' then 1 end) as positive_reviews,
       count(case when sentiment = 'neutral' then 1 end) as neutral_reviews,
       count(case when sentiment = 'negative' then 1 end) as negative_reviews,
       {share("count(case when sentiment = 'negative' then 1 end)", "nullif(count(review_score), 0)")} as pct_negative
from fct group by 1"""

QUERIES = {
    # Expressions.
    "missing_tokens": """select l_orderkey, l_linenumber, l_partkey,
        case l_returnflag when 'R' then 'R' end as flag, case when l_linestatus <> 'O' then l_linestatus end as status
        from lineitem""",
    "coerce_numbers": """select l_linenumber, count(*) as lines,
        count(case when l_linenumber in (1, 2, 3, 6) then 1 end) as numbers,
        cast(sum(case l_linenumber when 1 then cast(l_quantity as integer) when 2 then cast(l_quantity as integer)
                 when 3 then cast(l_quantity as integer) + 0.5 when 6 then cast(l_quantity as integer) * 10 end)
             as double) as number_total,
        count(case when l_linenumber in (1, 2, 6) then 1 end) as wholes,
        cast(sum(case l_linenumber when 1 then cast(l_quantity as integer) when 2 then cast(l_quantity as integer)
                 when 6 then cast(l_quantity as integer) * 10 end) as bigint) as whole_total
        from (select l_quantity, cast(l_linenumber as bigint) as l_linenumber from lineitem) group by 1""",
    "coerce_timestamps": f"""select o_orderkey,
        case o_orderstatus when 'F' then strftime(o_orderdate + to_hours(o_orderkey % 24), '{TS}')
             when 'O' then strftime(o_orderdate, '{TS}') end as moment from orders""",
    "zero_fill": """select c_custkey,
        case when length(cast(c_custkey as varchar)) >= 3 then cast(c_custkey as varchar)
             else lpad(cast(c_custkey as varchar), 3, '0') end as padded, c_name as stripped from customer""",
    "exact_average": """select seller_id, count(*) as n,
        ((2 * cast(sum(price) * 100 as bigint) + count(price)) // (2 * count(price))) / 100.0::double as avg_price
        from raw_order_items group by seller_id""",
    "day_attributes": """select distinct strftime(o_orderdate, '%Y-%m-%d') as day,
        dayofweek(o_orderdate) as day_of_week, rpad(monthname(o_orderdate), 9, ' ') as month_name,
        rpad(dayname(o_orderdate), 9, ' ') as day_name from orders""",
    # Operators.
    "csv_scan": f"""select cast(review_id as varchar) as review_id, cast(order_id as varchar) as order_id,
        cast(review_score as varchar) as review_score,
        case when review_comment_title <> 'error' then review_comment_title end as review_comment_title,
        'He said "' || review_comment_title || chr(34) || ',' || chr(10) || review_comment_message
            as review_comment_message,
        strftime(review_creation_date, '%Y-%m-%d %H:%M:%S') as review_creation_date,
        strftime(review_answer_timestamp, '%Y-%m-%d %H:%M:%S') as review_answer_timestamp from raw_reviews""",
    "keep_first": f"""select order_id, {longs("order_item_id")}, product_id, seller_id, {doubles("price")}
        from raw_order_items where arrival = 1""",
    "semi_filter": f"""select order_id, {longs("order_item_id")}, {doubles("price")} from raw_order_items
        where order_id in (select order_id from ord)""",
    "anti_filter": "select order_id, customer_id from raw_orders where order_id not in (select order_id from ord)",
    "null_orphans": """select customer_id, geolocation_zip_code_prefix as customer_zip_code_prefix
        from raw_customers left join geo on lpad(customer_zip_code_prefix, 5, '0') = geolocation_zip_code_prefix""",
    "rank_in_ranges": """select l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        rank() over (order by l_extendedprice desc nulls first) as price_rank,
        rank() over (order by l_quantity desc nulls first) as quantity_rank
        from lineitem""",
    "insert_if_absent": f"""select order_id, {longs("payment_sequential")}, payment_type,
        {longs("payment_installments")},
        cast(payment_value + case when payment_type = 'credit_card' then 0 else 1 end as double) as payment_value
        from payments""",
    "ingest_twice": TWICE,
    **{f"ingest_csv_{table}": query for table, query in FROM_CSV.items()},
    "catalog_tables": " union all ".join(
        f"select '{t.name}' as table_name, '{t.comment}' as table_comment, count(*) as stored from {block}"
        for t, block in zip(LOAD_ORDER, _CLEAN_BLOCKS)
    ),
    "stream_ingest": PAYMENTS,
    "stream_children_first": PAYMENTS,
    "reject_report": REJECTS,
    "load_report": REJECTS,
    "csv_unreadable": _chain(
        "customers",
        ("input", "select count(*) from raw_customers"),
        ("unreadable row", f"select count(*) from raw_customers where {_READABLE}"),
        (
            "missing customer_id, customer_unique_id",
            f"select count(customer_unique_id) from raw_customers where {_READABLE}",
        ),
        (
            "repeated customer",
            f"select count(distinct customer_id) from raw_customers"
            f" where {_READABLE} and customer_unique_id is not null",
        ),
    ),
    # Clean tables.
    "clean_geolocation": GEO,
    "clean_category_translation": "select * from translation",
    "clean_customers": "select * from customers",
    "clean_sellers": "select * from sellers",
    "clean_products": PRODUCTS,
    "clean_orders": ORDERS,
    "clean_order_items": ITEMS,
    "clean_payments": PAYMENTS,
    "clean_reviews": REVIEWS,
    # Models.
    "stg_orders": f"""select order_id, customer_id, order_status, {times(*STG_TIMES)}, delivery_delay_days, is_on_time
        from stg_orders""",
    "stg_customers": "select * from stg_customers",
    "stg_sellers": "select * from stg_sellers",
    "stg_products": f"""select product_id, product_category_name, category_name_english,
        {longs("product_name_length", "product_description_length", "product_photos_qty")},
        {doubles("weight_g", "length_cm", "height_cm", "width_cm")} from stg_products""",
    "stg_order_items": f"""select order_id, {longs("order_item_id")}, product_id, seller_id,
        {times("shipping_limit_date")}, {doubles("price", "freight_value", "total_amount")} from stg_items""",
    "stg_payments": PAYMENTS,
    "stg_order_reviews": REVIEWS.replace(" from reviews", ", sentiment from stg_reviews"),
    "fct_orders": FCT,
    "fct_orders_bucketed": FCT,
    "fct_orders_refreshed": FCT,
    "dim_customers": "select * from stg_customers",
    "dim_sellers": "select * from stg_sellers",
    "dim_products": f"""select product_id, product_category_name, category_name_english,
        {longs("product_photos_qty")}, {doubles("weight_g", "length_cm", "height_cm", "width_cm")}
        from stg_products""",
    "dim_dates": DATES,
    # Reports.
    "seller_geographic_reach": REACH,
    "seller_geographic_reach_bucketed": REACH,
    "payment_installments_by_state": INSTALLMENTS,
    "monthly_revenue_trend": TREND,
    "orders_by_month_layout": """select strftime(purchased_at, '%Y-%m') as purchase_month, order_status,
        count(*) as orders, cast(sum(total_order_value) as double) as total_value from fct group by 1, 2""",
    # Quality.
    "test_unique": """select order_id, cast(order_item_id as bigint) as order_item_id, count(*) as copies
        from raw_order_items group by order_id, order_item_id having count(*) > 1""",
    "test_not_null": """select customer_id, customer_city, customer_state from raw_customers
        where customer_unique_id is null""",
    "test_accepted_values": """select order_status, count(*) as copies from raw_orders
        where order_status = 'bogus' group by order_status""",
    "test_relationships": """select product_id, product_category_name from raw_products
        where product_category_name not in (select product_category_name from raw_translation)""",
    "quality_report": _quality(),
    "audit_primary_keys": _audit_keys(),
    "audit_foreign_keys": _audit_foreign_keys(),
    "audit_checks": _audit_checks(),
    "audit_not_null": _audit_not_null(),
    "propagate_deletes_cascade": " union all ".join(
        f"""select '{t}' as table_name, count(*) as rows_left from {b}
        where order_id in (select order_id from ord where order_status <> 'shipped')"""
        for t, b in list(_LOADED.items())[5:]
    ),
    "propagate_deletes_set_null": """
        select 'customers' as table_name, count(*) as rows_left, count(case when state is not null
               and zip_code is not null and zip_code not in (select geolocation_zip_code_prefix from geo
               where geolocation_lat < 0) then 1 end) as zips_left from stg_customers
        union all
        select 'sellers', count(*), count(case when state is not null
               and zip_code is not null and zip_code not in (select geolocation_zip_code_prefix from geo
               where geolocation_lat < 0) then 1 end) from stg_sellers
        union all
        select 'geolocation', count(*), count(*) from geo where geolocation_lat >= 0""",
    **{
        f"after_delete_{table}": f"""select * from ({query})
            where order_id not in (select order_id from ord where order_status = 'shipped')"""
        for table, query in (
            ("orders", ORDERS),
            ("order_items", ITEMS),
            ("payments", PAYMENTS),
            ("order_reviews", REVIEWS),
        )
    },
    "after_delete_geolocation": f"select * from ({GEO}) where geolocation_lat >= 0",
    **{
        f"after_delete_{table}": f"""select * replace (case when {zip} not in
            (select geolocation_zip_code_prefix from geo where geolocation_lat < 0) then {zip} end as {zip})
            from {table}"""
        for table, zip in (("customers", "customer_zip_code_prefix"), ("sellers", "seller_zip_code_prefix"))
    },
    # Further reports.
    "delay_impact_on_reviews": DELAY,
    "revenue_by_category": """select coalesce(category_name_english, 'no category') as category,
        count(*) as total_items, count(distinct order_id) as total_orders,
        cast(sum(total_amount) as double) as total_revenue
        from stg_items i join stg_products p on i.product_id = p.product_id group by 1""",
    "review_score_distribution": f"""select {longs("review_score")}, reviews,
        {share("reviews", "total")} as pct_reviews
        from (select review_score, count(*) as reviews from reviews group by 1),
             (select count(*) as total from reviews)""",
    "seller_performance": f"""select seller_id, count(*) as total_items, count(distinct i.order_id) as total_orders,
        cast(sum(total_amount) as double) as total_revenue,
        count(distinct case when delivered_at is not null then i.order_id end) as delivered_orders,
        count(distinct case when delivered_at is not null and not is_on_time then i.order_id end) as late_orders,
        {share("count(distinct case when delivered_at is not null and not is_on_time then i.order_id end)",
               "nullif(count(distinct case when delivered_at is not null then i.order_id end), 0)")} as pct_late
        from stg_items i join stg_orders o on i.order_id = o.order_id group by seller_id""",
    "delivery_delay_summary": f"""select month, state, n as delivered_orders,
        sign(delay) * ((200 * abs(delay) + n * 86400) // (2 * n * 86400)) / 100.0::double as avg_delay_days,
        late as late_orders, {share("late", "n")} as pct_late
        from (select strftime(purchased_at, '%Y-%m') as month, state, count(*) as n,
                     cast(sum(epoch(delivered_at) - epoch(estimated_delivery_at)) as bigint) as delay,
                     count(case when not is_on_time then 1 end) as late
              from stg_orders o join stg_customers c on o.customer_id = c.customer_id
              where delivered_at is not null group by 1, 2)""",
    "geo_customers": """select c.*, cast(geolocation_lat as double) as latitude,
        cast(geolocation_lng as double) as longitude
        from stg_customers c left join geo on zip_code = geolocation_zip_code_prefix""",
    "geo_sellers": """select s.*, cast(geolocation_lat as double) as latitude,
        cast(geolocation_lng as double) as longitude
        from stg_sellers s left join geo on zip_code = geolocation_zip_code_prefix""",
    "trade_between_states": """select s.state as seller_state, c.state as customer_state, count(*) as total_items,
        cast(sum(total_amount) as double) as total_revenue
        from stg_items i join stg_orders o on i.order_id = o.order_id
        join stg_customers c on o.customer_id = c.customer_id join stg_sellers s on i.seller_id = s.seller_id
        group by 1, 2""",
    "returning_shoppers": f"""select orders_placed, count(*) as shoppers,
        {share("count(*)", "sum(count(*)) over ()")} as pct_shoppers
        from (select customer_unique_id, count(*) as orders_placed
              from stg_orders o join stg_customers c on o.customer_id = c.customer_id group by 1) group by 1""",
}


def _metres(a: str, b: str) -> str:
    """Great-circle distance between two places of the block geo."""
    half = f"""pow(sin(radians({b}.geolocation_lat::double - {a}.geolocation_lat::double) / 2), 2)
        + cos(radians({a}.geolocation_lat::double)) * cos(radians({b}.geolocation_lat::double))
        * pow(sin(radians({b}.geolocation_lng::double - {a}.geolocation_lng::double) / 2), 2)"""
    return f"cast(round(2 * 6371000 * asin(sqrt(least({half}, 1.0)))) as bigint)"


QUERIES["cohorts"] = f"""
with active as (
    select customer_unique_id, date_trunc('month', purchased_at) as month, count(*) as orders
    from stg_orders o join stg_customers c on o.customer_id = c.customer_id where purchased_at is not null group by 1, 2),
first as (select customer_unique_id, min(month) as cohort from active group by 1),
matrix as (
    select cohort, date_diff('month', cohort, month) as months_since, count(*) as shoppers,
           cast(sum(orders) as bigint) as orders
    from active join first using (customer_unique_id) group by 1, 2)
select strftime(cohort, '%Y-%m') as cohort_month, months_since, shoppers, orders,
       {share("shoppers", "first_value(shoppers) over (partition by cohort order by months_since)")} as pct_of_cohort
from matrix"""
QUERIES["distance_by_state_pair"] = f"""
with pairs as (
    select s.state as seller_state, c.state as customer_state, {_metres("a", "b")} as metres
    from stg_items i join stg_orders o on i.order_id = o.order_id join stg_customers c on o.customer_id = c.customer_id
    join stg_sellers s on i.seller_id = s.seller_id join geo a on a.geolocation_zip_code_prefix = s.zip_code
    join geo b on b.geolocation_zip_code_prefix = c.zip_code)
select seller_state, customer_state, count(*) as total_items, cast(sum(metres) // count(*) as bigint) as avg_metres,
       min(metres) as min_metres, max(metres) as max_metres
from pairs group by 1, 2"""
QUERIES["nearest_sellers"] = f"""
select a.geolocation_zip_code_prefix as zip_code,
       arg_min(b.geolocation_zip_code_prefix, ({_metres("a", "b")}, b.geolocation_zip_code_prefix)) as nearest_zip,
       min({_metres("a", "b")}) as metres
from geo a, geo b where b.geolocation_zip_code_prefix in (select zip_code from stg_sellers) group by 1"""


def oracle() -> dict[str, str]:
    return {name: sql(query) for name, query in QUERIES.items()}
